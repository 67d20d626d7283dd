"""Access-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.audit import append_audit, audit_filter, audit_summary as summary, with_client_ip
from ..operators.predicates import time_literal
from ..session import scratch_path
from ..sources.tables import table
from . import params as P
from .catalogue import query
from .standins import audit_view, props_k

AUDIT_SQL = """
WITH audit AS (
  SELECT event_id AS id, event_type AS query_indicator,
         'user_' || CAST(user_id AS VARCHAR) AS query_user,
         'reason ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS query_reason,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
              ELSE '10.' || CAST(user_id % 256 AS VARCHAR) || '.'
                   || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) || '.1'
         END AS ip_address,
         ts AS create_time
  FROM events)
"""


@query("audit_search", "E1 E3 E4", AUDIT_SQL + """
SELECT * FROM audit
WHERE contains(lower(query_user), '1') AND contains(lower(query_indicator), 'click')
  AND create_time >= TIMESTAMP '2024-01-10 00:00:00' AND create_time <= TIMESTAMP '2024-01-20 00:00:00'
""")
def audit_search(spark, sf_dir):
    """User and indicator contain (any case), open date range on both ends."""
    return audit_filter(audit_view(spark, sf_dir), query_user="1", query_indicator="CLICK",
                        start_date="2024-01-10", end_date="2024-01-20")


@query("audit_summary", "G3 E7 E9", AUDIT_SQL + f"""
SELECT count(*) FILTER (WHERE contains(lower(query_user), '{P.AUDIT_USER_PART}')) AS access_total,
       count(*) FILTER (WHERE create_time >= TIMESTAMP '{P.RUN_DAY} 00:00:00') AS today_access_total,
       count(*) FILTER (WHERE ip_address IS NULL) AS abnormal_access_total,
       count(*) FILTER (WHERE create_time >= TIMESTAMP '{P.RUN_DAY} 00:00:00'
                          AND ip_address IS NULL) AS today_abnormal_access_total
FROM audit
""")
def audit_summary(spark, sf_dir):
    """Four audit counts in one pass."""
    return summary(audit_view(spark, sf_dir), P.RUN_DAY, query_user=P.AUDIT_USER_PART)


@query("client_ip_parse", "K5", """
WITH req AS (
  SELECT event_id,
         CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4
           WHEN 0 THEN NULL
           WHEN 1 THEN ''
           WHEN 2 THEN ' 10.0.' || CAST(user_id AS VARCHAR) || '.' || json_extract_string(props, '$.k') || ' , 192.168.0.1'
           ELSE ' , 10.9.9.9' END AS forwarded,
         '172.16.' || CAST(user_id % 256 AS VARCHAR) || '.1' AS peer
  FROM events)
SELECT event_id, forwarded, peer,
       CASE WHEN forwarded IS NULL OR forwarded = '' THEN peer
            ELSE trim(split_part(forwarded, ',', 1)) END AS client_ip
FROM req
""")
def client_ip_parse(spark, sf_dir):
    """Client address from a forwarded-for list: first entry trimmed, else the peer."""
    ev = table(spark, sf_dir, "events").withColumn("__k", props_k())   # parsed once
    k = F.col("__k")
    fwd = (F.when(k % 4 == 0, F.lit(None).cast("string"))
           .when(k % 4 == 1, F.lit(""))
           .when(k % 4 == 2, F.concat(F.lit(" 10.0."), F.col("user_id").cast("string"), F.lit("."),
                                      k.cast("string"), F.lit(" , 192.168.0.1")))
           .otherwise(F.lit(" , 10.9.9.9")))
    req = ev.select("event_id", fwd.alias("forwarded"),
                    F.concat(F.lit("172.16."), (F.col("user_id") % 256).cast("string"),
                             F.lit(".1")).alias("peer"))
    return with_client_ip(req, "forwarded", "peer")


@query("audit_append", "B10 K5", AUDIT_SQL + "SELECT * FROM audit")
def audit_append(spark, sf_dir):
    """Audit rows appended day by day of arrival (two appends), read back."""
    audit = audit_view(spark, sf_dir)
    path = scratch_path(spark, "audit")
    first = F.col("create_time") < time_literal(P.RUN_DAY)
    append_audit(audit.filter(first), path)
    append_audit(audit.filter(~first), path)
    return spark.read.parquet(path)
