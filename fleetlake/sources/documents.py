"""Semi-structured device documents.

A device document has scalars, a nested ``location``, a ``metrics`` map whose
keys depend on the device type, an optional ``alerts`` list and a few
type-specific optional fields.  Documents are read with an explicit schema
(never inferred: inference scans the data twice and drifts with new keys),
from JSON files or from a JSON text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import percent_value

# The schema of a device document.
ALERT = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

LOCATION = T.StructType([
    T.StructField("district", T.StringType()),
    T.StructField("street", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

DEVICE_DOCUMENT = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("location", LOCATION),
    T.StructField("install_date", T.StringType()),
    T.StructField("last_maintenance", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("alerts", T.ArrayType(ALERT)),
    # camera
    T.StructField("location_type", T.StringType()),
    T.StructField("storage_remaining", T.StringType()),
    T.StructField("streaming_quality", T.StringType()),
    # traffic light
    T.StructField("current_signal", T.StringType()),
    T.StructField("cycle_count", T.IntegerType()),
    T.StructField("intersection_id", T.StringType()),
    # environmental sensor
    T.StructField("installation_type", T.StringType()),
    T.StructField("battery_level", T.StringType()),
    T.StructField("last_calibration", T.StringType()),
    # smart streetlight
    T.StructField("control_mode", T.StringType()),
    T.StructField("light_level", T.IntegerType()),
    T.StructField("energy_saved", T.DoubleType()),
])

# Device statuses.
STATUSES = ["online", "offline", "fault", "maintenance"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines documents with the explicit schema; bad records become
    nulls (PERMISSIVE) and their text is kept in ``_corrupt_record``."""
    schema = T.StructType(DEVICE_DOCUMENT.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def parse_documents(df: DataFrame, text_col: str = "doc", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A8 for a JSON text column (for example a message value)."""
    return df.select(*keep, F.from_json(F.col(text_col), DEVICE_DOCUMENT).alias("d")) \
        .select(*keep, "d.*")


def document_time(c) -> Column:
    """A document's time text (a blank or ``T`` between day and time); null
    where it cannot be read, so one bad document does not stop a layer."""
    return F.col(c).try_cast("timestamp_ntz")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """A8 without a fixed schema: JSON lines as ``doc`` (VARIANT), so that keys
    which only some device types have stay readable.  ``doc`` is null where
    the text cannot be read; the text itself is kept."""
    return spark.read.text(path).select("value", F.try_parse_json("value").alias("doc"))


def readable(docs: DataFrame) -> Column:
    """Whether a text is one JSON object."""
    return F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))


def unreadable(docs: DataFrame) -> DataFrame:
    """The rejected texts."""
    return docs.where(~readable(docs)).select("value")


def field(path: str, kind: str, doc: str = "doc") -> Column:
    """K9: one field of a VARIANT; null where it is missing or of another type."""
    return F.try_variant_get(doc, path, kind)


def flatten_variants(docs: DataFrame) -> DataFrame:
    """D10 on VARIANT documents: the columns of ``flatten``."""
    lifted = docs.where(readable(docs)).select(
        field("$.doc_id", "bigint").alias("doc_id"),
        *[field(f"$.{c}", "string").alias(c) for c in ("device_id", "timestamp", "device_type", "ip_address", "status", "battery_level")],
        field("$.location", "variant").alias("location"), field("$.metrics", "map<string, variant>").alias("metrics"),
        field("$.alerts", "array<variant>").alias("alerts"))
    return lifted.select(
        "doc_id", "device_id", document_time("timestamp").alias("event_time"), "device_type", "ip_address", "status",
        *[field(f"$.{c}", kind, "location").alias(c) for c, kind in (
            ("district", "string"), ("street", "string"), ("latitude", "double"), ("longitude", "double"))],
        percent_value("battery_level").alias("battery_pct"),
        *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}") for c in ("metrics", "alerts")])


def variant_metrics(docs: DataFrame) -> DataFrame:
    """Every key of the metrics object as a row, whatever the device
    type calls it; values that are no numbers are null."""
    rows = docs.where(readable(docs)).select(
        field("$.doc_id", "bigint").alias("doc_id"), field("$.device_id", "string").alias("device_id"),
        field("$.device_type", "string").alias("device_type"), field("$.metrics", "variant").alias("metrics"))
    each = docs.sparkSession.tvf.variant_explode(F.col("metrics").outer())
    return rows.lateralJoin(each).select("doc_id", "device_id", "device_type", F.col("key").alias("metric"),
                                         field("$", "double", "value").alias("metric_value"))


def variant_alerts(docs: DataFrame) -> DataFrame:
    """One row per element of the alerts list."""
    rows = docs.where(readable(docs)).select(
        field("$.doc_id", "bigint").alias("doc_id"), field("$.device_id", "string").alias("device_id"),
        field("$.alerts", "variant").alias("alerts"))
    each = docs.sparkSession.tvf.variant_explode(F.col("alerts").outer())
    return rows.lateralJoin(each).select(
        "doc_id", "device_id", *[field(f"$.{c}", "string", "value").alias(c) for c in ("alert_id", "severity", "message")],
        field("$.timestamp", "string", "value").try_cast("timestamp_ntz").alias("alert_time"))


def flatten(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One detail row per document; struct fields lifted, counts of the
    nested collections, percent text parsed (K10), time parsed."""
    return docs.select(
        "doc_id", "device_id", document_time("timestamp").alias("event_time"),
        "device_type", "ip_address", "status",
        F.col("location.district").alias("district"), F.col("location.street").alias("street"),
        F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"),
        percent_value("battery_level").alias("battery_pct"),
        F.when(F.col("metrics").isNull(), 0).otherwise(F.size("metrics")).alias("n_metrics"),
        F.when(F.col("alerts").isNull(), 0).otherwise(F.size("alerts")).alias("n_alerts"), *keep,
    )


def metrics_long(docs: DataFrame) -> DataFrame:
    """The metrics map as (metric, metric_value) rows."""
    return docs.select("doc_id", "device_id", "device_type", F.explode("metrics").alias("metric", "metric_value"))


def alerts_long(docs: DataFrame) -> DataFrame:
    """One row per alert (documents without alerts yield none)."""
    return (docs.select("doc_id", "device_id", F.explode("alerts").alias("a"))
            .select("doc_id", "device_id", "a.alert_id", "a.severity", "a.message",
                    document_time("a.timestamp").alias("alert_time")))
