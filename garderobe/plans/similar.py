"""Similar items for every listing, and nearest items for a table of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.operators.neighbours import dense_top_k
from garderobe.operators.ranking import newest, top_n
from garderobe.operators.sparse import sparse_top_k
from garderobe.session import stage

SIMILAR = 12


def similar_by_vector(vectors: DataFrame, k: int = SIMILAR) -> DataFrame:
    """(listing_id, similar_id, score, rank): cosine neighbours of every vector, itself excluded."""
    flat = vectors.select(F.col("listing_id").alias("id"), "vector")
    top = dense_top_k(flat.withColumnRenamed("id", "qid"), flat, k, drop_self=True)
    return top.select(F.col("qid").alias("listing_id"), F.col("id").alias("similar_id"), "score", "rank")


def probe_neighbours(probes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Nearest listings of outside vectors; the score is the cosine mapped to 0..1."""
    top = dense_top_k(probes.select(F.col("probe_id").alias("qid"), "vector"),
                      vectors.select(F.col("listing_id").alias("id"), "vector"), k)
    return top.select(F.col("qid").alias("probe_id"), F.col("id").alias("listing_id"),
                      ((F.col("score") + 1) / 2).alias("score"), "rank")


def signature(column: str = "attribute_vector"):
    return F.to_json(F.array_sort(F.map_entries(column)))


def _signatures(pool: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Distinct tag vectors, and the ``keep`` newest members of each."""
    signed = pool.withColumn("sig", signature()).filter(F.size("attribute_vector") > 0)
    members = top_n(signed.select("sig", "listing_id", "last_seen_ms"), ["sig"], newest(), keep, "_m")
    return signed, members


def tag_neighbours(probes: DataFrame, pool: DataFrame, k: int = SIMILAR, same_ids: bool = True) -> DataFrame:
    """(probe_id, listing_id, score, rank) by tag cosine > 0, newest first among equals.

    ``probes`` has (probe_id, attribute_vector). Listings with the same tags are one signature: neighbours are found
    between distinct signatures only, and each signature brings its newest members. The first k + 1 signatures with k + 1
    members each always contain the answer, since every signature ahead of a listing's own brings a listing ahead of it.
    """
    keep = k + 1 if same_ids else k
    signed, members = _signatures(pool, keep)
    asked = probes.withColumn("psig", signature()).filter(F.size("attribute_vector") > 0)
    head = members.groupBy("sig").agg(F.max("last_seen_ms").alias("tie"))
    cells = signed.select("sig", "attribute_vector").dropDuplicates(["sig"]).join(head, "sig").select(F.col("sig").alias("id"), F.col("attribute_vector").alias("tags"), "tie")
    wanted = asked.select(F.col("psig").alias("qid"), F.col("attribute_vector").alias("tags")).dropDuplicates(["qid"])
    top = sparse_top_k(wanted, cells, keep).select("qid", "id", "score")
    offered = top.join(members, F.col("id") == F.col("sig")).select(
        F.col("qid").alias("psig"), "listing_id", "last_seen_ms", "score")
    order = [F.desc("score"), *newest()]
    offered = stage(top_n(offered, ["psig"], order, keep, "_o"), "tag-offered")
    # A probe that is asked once takes its signature's list in place, in order: its rows are neither sorted nor shuffled.
    asked, best = asked.select("probe_id", "psig"), offered.groupBy("psig").agg(F.array_sort(F.collect_list(F.struct("_o", "listing_id", "score"))).alias("_best"))
    repeated = asked.groupBy("probe_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("probe_id").alias("_again"))
    again = F.col("probe_id").eqNullSafe(F.col("_again"))
    others = F.filter("_best", lambda b: F.col("probe_id") != b["listing_id"]) if same_ids else F.col("_best")
    once = asked.join(repeated, again, "left_anti").join(best, "psig").select("probe_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_b")).select(
        "probe_id", "_b.listing_id", "_b.score", (F.col("_at") + 1).alias("rank"))
    rows = asked.join(repeated, again, "left_semi").join(offered.drop("_o"), "psig")
    if same_ids:
        rows = rows.filter(F.col("probe_id") != F.col("listing_id"))
    return once.unionByName(top_n(rows, ["probe_id"], order, k).select("probe_id", "listing_id", "score", "rank"))


def attribute_fallback(lonely: DataFrame, pool: DataFrame, k: int = SIMILAR) -> DataFrame:
    """Newest listings sharing the silhouette or the length class, for probes without tag neighbours."""
    parts = []
    for attr in ("silhouette", "length_class"):
        best = top_n(pool.filter(F.col(attr).isNotNull()).select(attr, "listing_id", "last_seen_ms"), [attr], newest(), k + 1,
                     "_r")
        parts.append(lonely.select("probe_id", attr).join(best, attr).select("probe_id", "listing_id", "last_seen_ms"))
    rows = parts[0].unionByName(parts[1]).dropDuplicates(["probe_id", "listing_id"])
    rows = rows.filter(F.col("probe_id") != F.col("listing_id"))
    return top_n(rows, ["probe_id"], newest(), k).select("probe_id", "listing_id", F.lit(0.0).alias("score"), "rank")


def similar_by_tags(pool: DataFrame, k: int = SIMILAR) -> DataFrame:
    """Tag neighbours of every pool listing with the attribute fallback where there are none."""
    probes = pool.select(F.col("listing_id").alias("probe_id"), "attribute_vector", "silhouette", "length_class")
    near = stage(tag_neighbours(probes, pool, k), "tag-neighbours")
    lonely = probes.join(near.select("probe_id").distinct(), "probe_id", "left_anti")
    rest = attribute_fallback(lonely, pool, k)
    return near.withColumn("basis", F.lit("tags")).unionByName(rest.withColumn("basis", F.lit("fallback")))


def nearest_or_newest(probes: DataFrame, pool: DataFrame, k: int, min_confidence: float = 0.5) -> DataFrame:
    """Tag neighbours of outside probes; a probe without any gets the newest well-extracted listings."""
    near = stage(tag_neighbours(probes, pool, k, same_ids=False), "tag-neighbours").withColumn("fallback", F.lit("none"))
    lonely = probes.select("probe_id").join(near.select("probe_id").distinct(), "probe_id", "left_anti")
    fresh = pool.filter(F.col("confidence") >= min_confidence).orderBy(*newest()).limit(k).select("listing_id").collect()  # k rows
    best = F.array(*[F.struct(F.lit(r["listing_id"]).alias("listing_id"), F.lit(i).alias("rank")) for i, r in enumerate(fresh, 1)])
    if not fresh:
        return near
    rest = lonely.select("probe_id", F.inline(best)).select("probe_id", "listing_id", F.lit(0.0).alias("score"), "rank", F.lit("nearest").alias("fallback"))
    return near.unionByName(rest)
