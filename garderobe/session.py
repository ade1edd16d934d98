"""Session settings and the places a job may write intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "garderobe", cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass in your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", extra.pop("driver_memory", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on (UTC instants, JSON objects that repeat a key), and the package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application: they may start in any folder of any machine."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package, archive = os.path.dirname(os.path.abspath(__file__)), os.path.join(tempfile.mkdtemp(prefix="garderobe-"), "garderobe.zip")  # served by the driver as long as it runs
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for place, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        out.write(os.path.join(place, name), os.path.relpath(os.path.join(place, name), os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    ``spark.checkpoint.dir`` names it on a cluster; a local folder is used only where nothing is set and the master is local, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="garderobe-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives executor loss. ``compression``: other than the session's, for long texts."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out to all cores by ``keys``, for short rows before costly columns: their bytes alone would ask for few tasks.

    The hash stands for the keys as a shuffle by the keys themselves is left out after a join on them, whose tasks are few again.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*keys))


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def stage_once(spark: SparkSession, label: str, scope: str, build) -> DataFrame:
    """A derived table many plans read, written on first use of this application and read from the shared folder after."""
    key = (spark.sparkContext.applicationId, scope, label)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), label)
    return _STAGED[key]
