"""State of a stream as a table in buckets of its key, with a manifest a version: a restarted stream goes on from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from garderobe.session import stage
from garderobe.streaming.runtime import read_or_empty

BUCKETS = 64
MOST_SENT = 1_000_000  # keys of a batch that are sent to every executor
MANIFEST = "bucket int, version long, n long, v long"
Held = dict[int, list[tuple[int, int]]]  # bucket -> (version, number of rows) in order: the first has the bucket whole, the others what changed since


class StateTable:
    """Rows under ``folder``, each in the bucket of its ``keys``.

    A version holds all rows of the keys that its batch changed, and a manifest names, for every bucket, the versions that make it up: a
    key's rows are those of the last version that has the key. A bucket is written whole when the rows changed since it last was would
    outnumber it, so what is written in all stays within a few times what changed. The manifest is written last, so a version without one
    does not exist; a replayed batch starts from the versions before its own and overwrites what it had written. Folders of versions that
    no manifest in use names can be removed.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType | str, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.schema, self.buckets = spark, folder, keys, schema, buckets

    def versions(self, before: int | None = None) -> Held:
        """The versions that hold each bucket, as the last manifest before that of a batch says (the last of all if none is given)."""
        manifests = read_or_empty(self.spark, MANIFEST, f"{self.folder}/manifest")
        if before is not None:
            manifests = manifests.filter(F.col("v") < before)
        last = manifests.agg(F.max("v")).first()[0]
        held: Held = {}
        if last is not None:
            for r in manifests.filter((F.col("v") == last) & F.col("bucket").isNotNull()).orderBy("version").collect():
                held.setdefault(r.bucket, []).append((r.version, r.n or 0))
        return held

    def _rows(self, held: Held) -> DataFrame:
        """All rows that the versions hold, with ``v`` and ``bucket``."""
        paths = [f"{self.folder}/data/v={version}/bucket={bucket}" for bucket, parts in sorted(held.items()) for version, _ in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumns({"v": F.lit(0), "bucket": F.lit(0)})
        return self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/data").parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = F.max("v").over(Window.partitionBy(*self.keys))
        return rows.withColumn("_last", last).filter(F.col("v") == F.col("_last")).drop("_last")

    def read(self, held: Held) -> DataFrame:
        """The rows of the buckets; only buckets in several versions are compared by key."""
        whole, cut = {b: p for b, p in held.items() if len(p) == 1}, {b: p for b, p in held.items() if len(p) > 1}
        return self._rows(whole).unionByName(self._newest(self._rows(cut))).drop("v", "bucket")

    def current(self) -> DataFrame:
        return self.read(self.versions())

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _among(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.keys], how)

    def write(self, rows: DataFrame, version: int, held: Held, whole: set[int] | None = None) -> None:
        """Writes rows as a version: the buckets in ``whole`` (all if none are given) are replaced by it, the others changed."""
        path = f"{self.folder}/data/v={version}"
        self.bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(path)
        counts = self.bucketed(self.spark.read.schema(self.schema).parquet(path)).groupBy("bucket").count().collect()
        parts = held | {r["bucket"]: [*([] if whole is None or r["bucket"] in whole else held.get(r["bucket"], [])), (version, r["count"])] for r in counts}
        named = [(b, v, n) for b, own in sorted(parts.items()) for v, n in own] or [(None, None, None)]
        self.spark.createDataFrame(named, "bucket int, version long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")

    def advance(self, changes: DataFrame, version: int, step: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Applies ``step(rows before, changes)`` to the keys of ``changes`` and writes their rows.

        Rows of other keys are neither given to ``step`` nor shuffled, and written only with a bucket that is due to be whole again.
        ``step`` keeps at least one row of each key. Up to ``MOST_SENT`` keys of a batch are sent to the tasks.
        """
        changes = stage(changes, "changes")  # read several times
        held = self.versions(version)
        keys = self.bucketed(changes.select(*self.keys).distinct())
        touched = {r["bucket"]: r["count"] for r in keys.groupBy("bucket").count().collect()}
        keys = keys.select(*(F.col(k).alias(f"_key_{k}") for k in self.keys))
        keys = F.broadcast(keys) if sum(touched.values()) <= MOST_SENT else keys
        own = {b: held[b] for b in touched if b in held}
        whole = {b for b, n in touched.items() if n + sum(m for _, m in held.get(b, [])[1:]) >= held.get(b, [(0, 0)])[0][1]}
        before = self._newest(self._among(self._rows(own), keys, "left_semi")).drop("v", "bucket")
        rows = step(before, changes)
        due = {b: p for b, p in own.items() if b in whole}
        if due:
            rows = rows.unionByName(self._among(self.read(due), keys, "left_anti"))
        self.write(rows, version, held, whole)
