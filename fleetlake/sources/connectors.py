"""Readers and writers chosen by source type.

One alias table maps every spelling of a source type to one dialect; each
dialect has its own URL builder.  JDBC reads can be split into parallel
range reads on a numeric column (B8) and take the increment predicate as a
pushed filter.  Only Parquet, JSON, CSV and JDBC ship with Spark; MongoDB and
Kafka need their connector packages on the classpath, so those code paths are
written against the public connector options but are not exercised by tests.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession

# Source-type spellings seen in the registry and the dialect each means.
ALIASES = {
    "mysql": "mysql",
    "postgresql": "postgresql", "postgres": "postgresql",
    "oracle": "oracle",
    "sqlserver": "sqlserver", "sql server": "sqlserver", "mssql": "sqlserver",
    "dm": "dm", "dameng": "dm",
    "mongodb": "mongodb", "mongo": "mongodb",
    "kafka": "kafka",
    "hdfs": "files", "parquet": "files", "files": "files",
}

# JDBC URL layout and driver class of each dialect.
JDBC = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}",
                  "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "dm": ("jdbc:dm://{host}:{port}/{database}", "dm.jdbc.driver.DmDriver"),
}


def dialect(source_type: str) -> str:
    try:
        return ALIASES[source_type.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown source type {source_type!r}") from None


@dataclass(frozen=True)
class Source:
    """A registry entry: where a table lives.  ``password`` never leaves here."""
    type: str
    host: str = ""
    port: int = 0
    database: str = ""
    username: str = ""
    password: str = ""
    path: str = ""           # files / HDFS

    def url(self) -> str:
        d = dialect(self.type)
        if d not in JDBC:
            raise ValueError(f"{self.type} is not a JDBC source")
        return JDBC[d][0].format(host=self.host, port=self.port, database=self.database)


def mongo_uri(src: Source) -> str:
    """The connection address with its credentials, if any."""
    login = f"{quote_plus(src.username)}:{quote_plus(src.password)}@" if src.username else ""
    return f"mongodb://{login}{src.host}:{src.port}"


def read_query(spark: SparkSession, src: Source, sql: str, fetch_size: int = 10_000) -> DataFrame:
    """A1: a lazy DataFrame over a configured query text, run by the source;
    later filters are added around it.  For files, the query names tables as
    ``{table}`` and Spark runs it."""
    d = dialect(src.type)
    if d == "files":
        names = {n for _, n, _, _ in Formatter().parse(sql) if n}
        return spark.sql(sql, **{n: spark.read.parquet(f"{src.path.rstrip('/')}/{n}.parquet") for n in names})
    if d not in JDBC:
        raise ValueError(f"{src.type} takes no query text")
    return (spark.read.format("jdbc").option("url", src.url()).option("driver", JDBC[d][1]).option("query", sql)
            .option("user", src.username).option("password", src.password).option("fetchsize", fetch_size).load())


def read_table(spark: SparkSession, src: Source, table: str, *,
               partition_column: str | None = None, lower: int | None = None,
               upper: int | None = None, num_partitions: int = 1,
               fetch_size: int = 10_000) -> DataFrame:
    """A lazy DataFrame over one source table.

    Later ``filter``/``select`` calls are pushed into the source query (JDBC
    ``PushedFilters``, Parquet row-group skipping).  With ``partition_column``
    the JDBC read is split into ``num_partitions`` range queries.
    """
    d = dialect(src.type)
    if d == "files":
        return spark.read.parquet(f"{src.path.rstrip('/')}/{table}")
    if d == "mongodb":
        return (spark.read.format("mongodb")
                .option("connection.uri", mongo_uri(src))
                .option("database", src.database).option("collection", table).load())
    if d == "kafka":
        raise ValueError("use messages.bounded_kafka_read for Kafka topics")
    url, driver = src.url(), JDBC[d][1]
    reader = (spark.read.format("jdbc").option("url", url).option("driver", driver)
              .option("dbtable", table).option("user", src.username)
              .option("password", src.password).option("fetchsize", fetch_size))
    if partition_column is not None and num_partitions > 1:
        if lower is None or upper is None:
            raise ValueError("partitioned JDBC reads need lower and upper bounds")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    return reader.load()


def write_table(df: DataFrame, src: Source, table: str, mode: str = "append",
                partition_by: list[str] | None = None, num_partitions: int | None = None) -> None:
    """Append (or overwrite) into the target by its type.

    Files are written as Parquet, partitioned when asked; with dynamic
    partition overwrite only the partitions present in ``df`` are replaced.
    JDBC writes use ``numPartitions`` parallel connections; ``truncate`` keeps
    the target table definition on overwrite.
    """
    d = dialect(src.type)
    if d == "files":
        w = df.write.mode(mode)
        if partition_by:
            # overwrite replaces only the partitions present in df (B2)
            w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
        w.parquet(f"{src.path.rstrip('/')}/{table}")
        return
    if d == "mongodb":
        (df.write.format("mongodb").mode(mode)
         .option("connection.uri", mongo_uri(src))
         .option("database", src.database).option("collection", table).save())
        return
    if d == "kafka":
        (df.write.format("kafka").option("kafka.bootstrap.servers", f"{src.host}:{src.port}")
         .option("topic", table).save())
        return
    url, driver = src.url(), JDBC[d][1]
    w = (df.write.format("jdbc").mode(mode).option("url", url).option("driver", driver)
         .option("dbtable", table).option("user", src.username).option("password", src.password)
         .option("truncate", "true").option("batchsize", 10_000))
    if num_partitions:
        w = w.option("numPartitions", num_partitions)
    w.save()
