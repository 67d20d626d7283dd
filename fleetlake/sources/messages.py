"""Keyed JSON messages (B5, J3) and bounded offset reads.

A message is ``(topic, key, value)``: the key is the text of the key column
and the value the JSON of the whole row with datetimes as ISO text.  Writing
goes through Spark's Kafka sink when the connector is on the classpath; the
same frame can be written to files (``publish``: a folder per topic and
partition).

A log kept as files is a folder of segments, each a range of offsets
(``append_segments``), with an index of one row per segment; an append adds
its rows of the index as one folder.  A bounded read chooses its segments from
the index and goes to their folders, so it lists and opens only files that hold
wanted records, however long the log and whatever its gaps.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import iso_json


def keyed_json(df: DataFrame, key_column: str, topic: str | Column | None = None,
               value_columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``key`` = text of ``key_column``, ``value`` = JSON of the row.

    ``topic`` may be a column (J3: one topic per device type).  With
    ``partitions`` a ``partition`` column sends all messages of a key to one
    partition of that many (the sink honours it).
    """
    cols = value_columns or df.columns
    out = [F.col(key_column).cast("string").alias("key"),
           iso_json(F.struct(*[F.col(c) for c in cols])).alias("value")]
    if partitions:
        out.append(key_partition(F.col(key_column).cast("string"), partitions).alias("partition"))
    if topic is not None:
        out.insert(0, (F.lit(topic) if isinstance(topic, str) else topic).alias("topic"))
    return df.select(*out)


def key_partition(key: Column, partitions: int) -> Column:
    """A partition number from the first 28 bits of the key's MD5; no key, no
    choice."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long"), F.lit(partitions)).cast("int")


def send(messages: DataFrame, bootstrap_servers: str, topic: str | None = None) -> None:
    """Write a ``(topic?, key, value)`` frame to Kafka (needs the Kafka connector)."""
    w = messages.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
    if topic is not None:
        w = w.option("topic", topic)
    w.save()


def bounded_kafka_read(spark: SparkSession, bootstrap_servers: str, topic: str,
                       max_messages: int, start_offset: int | None = None,
                       partition: int = 0, span: int | None = None) -> DataFrame:
    """A7 over Kafka: partition ``partition`` from ``start_offset + 1`` (earliest
    when absent), at most ``max_messages`` records, as the caller states.

    With ``span`` the read ends that many offsets after its start, so one call
    never reads the rest of the log; offsets may have gaps, so the caller goes
    on with a wider span when fewer records than asked come back.  Without it
    the far end is open.  Batch read; no consumer group state is kept, the
    caller stores the last offset it processed."""
    tp = json.dumps({topic: [partition]})
    starting = "earliest" if start_offset is None else json.dumps({topic: {str(partition): start_offset + 1}})
    ending = "latest" if span is None else json.dumps({topic: {str(partition): (start_offset or 0) + 1 + span}})
    df = (spark.read.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
          .option("assign", tp).option("startingOffsets", starting)
          .option("endingOffsets", ending).load())
    return bounded_slice(df, "offset", start_offset, max_messages).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "offset", "timestamp")


def bounded_slice(log: DataFrame, offset_column: str, start_offset: int | None,
                  max_messages: int) -> DataFrame:
    """A7 on any offset-ordered log: records after ``start_offset``, at most
    ``max_messages``, in offset order.  The range predicate reaches the scan;
    the cap is a per-partition top-k, so no task ever holds the whole log."""
    rows = log if start_offset is None else log.filter(F.col(offset_column) > F.lit(start_offset))
    return rows.orderBy(offset_column).limit(max_messages)


def append_segments(rows: DataFrame, root: str, offset_column: str, segment: int) -> None:
    """Append records to a log folder: one segment per ``segment`` offsets
    (``data/segment=<n>``), and its first and last offset and number of rows
    in the index.  Segments present in ``rows`` are replaced, so a repeated
    append changes nothing; ``rows`` holds whole segments.

    The index gets one folder per append (``index/part=<n>``, in the order of
    appends); of a segment that several hold, the last one counts."""
    spark = rows.sparkSession
    placed = rows.withColumn("segment", F.floor(F.col(offset_column) / segment).cast("long"))
    (placed.repartition("segment").sortWithinPartitions("segment", offset_column).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{root}/data"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/index")
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    last = spark.read.schema("part long").parquet(f"{root}/index").agg(F.max("part")).head()[0] if known else None
    index = placed.where("segment is not null").groupBy("segment").agg(
        F.min(offset_column).alias("first"), F.max(offset_column).alias("last"), F.count("*").alias("rows"))
    index.write.mode("append").parquet(f"{root}/index/part={0 if last is None else last + 1}")


def segments_for(spark: SparkSession, root: str, start_offset: int | None, max_messages: int) -> list[int]:
    """The segments that hold the first ``max_messages`` records after
    ``start_offset``: at most as many as the records asked for, plus one."""
    index = spark.read.parquet(f"{root}/index").groupBy("segment").agg(
        F.max_by(F.struct("first", "last", "rows"), "part").alias("x")).select("segment", "x.*")
    if start_offset is not None:
        index = index.where(F.col("last") > start_offset)
    # Only what certainly lies after the start counts towards the limit.
    whole = F.col("rows") if start_offset is None else F.when(F.col("first") > start_offset, F.col("rows")).otherwise(0)
    nearest = index.withColumn("n", whole).orderBy("first").limit(max_messages + 1)
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    chosen = nearest.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_messages)
    return [r.segment for r in chosen.select("segment").collect()]


def bounded_log_read(spark: SparkSession, root: str, offset_column: str, start_offset: int | None,
                     max_messages: int) -> DataFrame:
    """A7 with a bounded far end: at most ``max_messages`` records after
    ``start_offset``, in offset order, from the segments that hold them."""
    wanted = segments_for(spark, root, start_offset, max_messages)
    # With none wanted, any segment tells the columns.
    seen = wanted or [r.segment for r in spark.read.parquet(f"{root}/index").select("segment").limit(1).collect()]
    log = spark.read.option("basePath", f"{root}/data").parquet(*[f"{root}/data/segment={n}" for n in seen]) \
        .where(F.col("segment").isin(wanted)).drop("segment")
    return bounded_slice(log, offset_column, start_offset, max_messages)


def publish(stream: DataFrame, path: str, checkpoint: str, key_column: str, topic_column: str, topics: list[str],
            partitions: int = 3, trigger: dict | None = None) -> StreamingQuery:
    """Keyed JSON of every row of a stream into ``path``, a folder per topic
    and partition.  All messages of a key go to one partition of its topic;
    one task writes one partition of one topic.  A micro-batch sent again
    replaces itself.  Rows of a topic not in ``topics`` raise."""
    number = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    place = F.when(number > 0, (number - 1).cast("int") * partitions + F.coalesce("partition", F.lit(0))) \
        .otherwise(F.raise_error(F.concat(F.lit("unknown topic: "), F.coalesce("topic", F.lit("null")))).cast("int"))

    def write(rows: DataFrame, batch_id: int) -> None:
        messages = keyed_json(rows, key_column, topic=F.col(topic_column), partitions=partitions)
        (messages.repartitionById(len(topics) * partitions, place).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "topic", "partition").parquet(path))

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())
