"""Session construction and the shared working folder.

The library never decides cluster sizing on its own: ``local_session`` is for
tests and the bench only; on a cluster the caller's session is used as is.
Lineage cuts and intermediate tables go to the folder named by
``spark.checkpoint.dir`` (shared storage on a cluster).  A local temporary
folder is only created when that setting is unset, which happens in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours wants; they are only applied where the
# caller has not chosen a value already.  Write behaviour (dynamic partition
# overwrite) is passed per write, never switched on for the whole session.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "fleetlake") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FLEETLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Pin the settings our semantics rely on (UTC, AQE) unless already set."""
    for key, value in DEFAULT_CONF.items():
        try:
            if spark.conf.get(key, None) in (None, ""):
                spark.conf.set(key, value)
        except Exception:  # static or unmodifiable settings stay as they are
            pass
    # Time zone is part of the result semantics (S13): pin it when it is the
    # JVM default rather than an explicit choice.
    if "spark.sql.session.timeZone" not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder under the one named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset and the master is local
    (tests) a folder is created and registered.  On a cluster an unset folder
    is an error: nothing shared may land on one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_value = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_value:
        sc.setCheckpointDir(conf_value)
        return (sc.getCheckpointDir() or conf_value).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="fleetlake-ckpt-")
    sc.setCheckpointDir(local)
    return (sc.getCheckpointDir() or local).rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The shared folder itself, the same for every application: Spark keeps
    each application's checkpoints in a folder of a random name inside it."""
    conf_value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return conf_value.rstrip("/") if conf_value else checkpoint_dir(spark).rpartition("/")[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_root(spark)}/fleetlake/{name}/{uuid.uuid4().hex}"
