"""Running streams to the end of the available input.

Sinks and checkpoints go to the folder ``home`` that the caller names: called again with the same folder, a stream goes on where it
stopped, and its result covers all input so far. Without one they go to a new place in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from garderobe.operators.ranking import latest_by
from garderobe.session import scratch_path


def file_stream(spark: SparkSession, folder: str, glob: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream over parquet files; the schema is read from them, and a micro-batch takes a bounded number of files."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def place(spark: SparkSession, label: str, home: str | None) -> str:
    return f"{home}/{label}" if home else scratch_path(spark, label)


def read_or_empty(spark: SparkSession, schema: StructType | str, path: str) -> DataFrame:
    """The rows written to a folder, none while nothing was."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(stream: DataFrame, label: str, each: Callable[[DataFrame, int], None], mode: str = "append", home: str | None = None) -> None:
    """Process everything available through ``each(batch, batch_id)`` and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).trigger(availableNow=True)
        .option("checkpointLocation", place(stream.sparkSession, f"{label}-offsets", home)).start()
    )
    query.awaitTermination()


def to_table(stream: DataFrame, label: str, mode: str = "append", home: str | None = None) -> DataFrame:
    """Sink a stream to parquet, one folder per batch (a replayed batch overwrites its own), and read it back."""
    spark = stream.sparkSession
    path = place(spark, label, home)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run(stream, label, write, mode, home)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return read_or_empty(spark, fields + ", batch bigint", path)


def latest_state(stream: DataFrame, label: str, keys: list[str], home: str | None = None) -> DataFrame:
    """Result of an update-mode aggregate: the last version of each key over all batches."""
    return latest_by(to_table(stream, label, "update", home), keys, F.col("batch"), [c for c in stream.columns if c not in keys])


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)
