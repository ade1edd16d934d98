"""Ranked lexical search over an index of documents of equal length.

Documents with the same length normaliser ``m`` are a stratum. A stratum's postings are kept by term and, within a term, by how often it
occurs (``tf``): all documents of such a level gain the same, so an impact is worked out once a level. The highest level of every term
bounds what a document of the stratum can score for an item; strata are visited by that bound, highest first, until it falls below the
score that as many documents as asked for are known to reach.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garderobe.session import stage

BEST = 10
#: Bytes of a text with A-Z lower-cased and all other ASCII but letters and digits as spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CHUNK = 1 << 20  # bytes of a text that are cut into terms at once
SEGMENT = 4096  # most documents of one stratum in a row of the index
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000  # items that are searched in one pass: so many, with about so many terms at most
COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"
INDEX = "m long, docs array<long>, term array<int>, tf array<long>, ends array<int>, places array<int>"
FOUND = "item int, doc_id long, score long"


def term_chunks(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of bounded size; no term is cut."""
    data, at = (text or "").encode().translate(PLAIN), 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """A block of items: every item's distinct terms as places in the block's sorted vocabulary."""

    ids: list = field(default_factory=list)
    own: list[list[bytes]] = field(default_factory=list)
    n_terms: int = 0

    def add(self, item_id, terms: set[bytes]) -> None:
        self.ids.append(item_id)
        self.own.append(sorted(terms))
        self.n_terms += len(terms)

    def vocabulary(self) -> list[bytes]:
        return sorted(set().union(*map(set, self.own)))


def blocks_of_items(items: DataFrame) -> Iterator[Items]:
    """Items in blocks of bounded size, one partition at a time on the driver. An item's text is cut into terms there; a null text has none."""
    block = Items()
    for row in items.select("item_id", "text").toLocalIterator():
        terms = {t for chunk in term_chunks(row["text"]) for t in chunk}
        if block.ids and (len(block.ids) >= BLOCK_ITEMS or block.n_terms + len(terms) > BLOCK_TERMS):
            yield block
            block = Items()
        block.add(row["item_id"], terms)
    if block.ids:
        yield block


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms are counted in ``n``, those of the vocabulary one by one."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: i for i, term in enumerate(sent.value)}
        for batch in batches:
            kept, n, terms, tfs = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                counts, total = Counter(), 0
                for chunk in term_chunks(text):
                    counts.update(chunk)
                    total += len(chunk)
                if total:
                    own = [(place[t], c) for t, c in counts.items() if t in place]
                    kept.append(k)
                    n.append(total)
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return stage(docs.select("doc_id", "text").mapInArrow(rows, COUNTED), "terms")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and where each list ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def build_index(counted: DataFrame, documents: int, length: int) -> DataFrame:
    """The index of counted documents: a row holds up to ``SEGMENT`` documents of one stratum, with their postings by term and tf.

    Every task sorts its documents by ``m`` (spilling if need be) and writes its strata; no document moves, so copies, one length or one
    term may make up most rows. Documents without a term of the vocabulary are left out.
    """
    sized = counted.filter(F.size("terms") > 0).withColumn("m", F.expr(f"10L + (90L * n * {documents}L) div {max(1, length)}L")).select("m", "doc_id", "terms", "tfs")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("m").to_numpy()
            (terms, ends), (tfs, _) = _lists(batch.column("terms")), _lists(batch.column("tfs"))
            starts = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            cuts = np.unique(np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(starts, [*starts[1:], len(m)], strict=True)] + [[len(m)]]))
            out = {name: [] for name in ("m", "docs", "term", "tf", "ends", "places")}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                t, f = terms[ends[a] : ends[b]], tfs[ends[a] : ends[b]]
                of = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[a : b + 1]))
                order = np.lexsort((of, f, t))
                t, f = t[order], f[order]
                level = np.flatnonzero(np.concatenate(((t[1:] != t[:-1]) | (f[1:] != f[:-1]), [True])))
                for name, value in (("m", m[a]), ("docs", batch.column("doc_id").slice(a, b - a)), ("term", t[level]), ("tf", f[level]), ("ends", (level + 1).astype(np.int32)), ("places", of[order])):
                    out[name].append(value)
            kinds = {"docs": pa.int64(), "term": pa.int32(), "tf": pa.int64(), "ends": pa.int32(), "places": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(out["m"], pa.int64()), *(pa.array([v.to_pylist() if name == "docs" else v for v in out[name]], pa.list_(kind)) for name, kind in kinds.items())], ["m", *kinds])

    return stage(sized.sortWithinPartitions("m", "doc_id").mapInArrow(rows, INDEX), "strata")


class Segment:
    """One row of the index with its impacts and what it can give each item at most."""

    def __init__(self, m: int, docs: list, term: np.ndarray, tf: np.ndarray, ends: np.ndarray, places: np.ndarray, weights: np.ndarray):
        self.docs, self.places = docs, places
        levels = weights[term] * impact(tf, m)
        self.gain = np.repeat(levels, np.diff(ends, prepend=0))
        last = np.flatnonzero(np.concatenate((term[1:] != term[:-1], [True])))
        self.terms, self.most = term[last], levels[last]  # the highest tf of a term is its last level
        self.ends = ends[last]

    def scores(self, own: np.ndarray) -> np.ndarray:
        """Scores of all documents of the row for an item's terms."""
        at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        at = at[self.terms[at] == own]
        total = np.zeros(len(self.docs), np.int64)
        stretches = [slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k])) for k in at.tolist()]
        if stretches:
            np.add.at(total, np.concatenate([self.places[s] for s in stretches]), np.concatenate([self.gain[s] for s in stretches]))
        return total


def _better(row: tuple) -> tuple:
    score, doc = row
    return -score, doc is None, doc or 0


def visit(segments: list[Segment], own: list[np.ndarray], holders: tuple[np.ndarray, np.ndarray], best: list[list[tuple]], k: int) -> None:
    """Brings every item's best documents up to date: segments by bound, highest first, as long as they can still matter."""
    items, ends = holders
    bounds = np.zeros((len(own), len(segments)), np.int64)
    for s, segment in enumerate(segments):
        n = ends[segment.terms + 1] - ends[segment.terms]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(upto[-1]) + np.repeat(ends[segment.terms] - upto[:-1], n)
        np.add.at(bounds[:, s], items[at], np.repeat(segment.most, n))
    for i, terms in enumerate(own):
        for s in np.argsort(-bounds[i], kind="stable").tolist():
            floor = best[i][-1][0] if len(best[i]) >= k else 1
            if bounds[i, s] < floor or bounds[i, s] <= 0:
                break
            scores = segments[s].scores(terms)
            able = np.flatnonzero(scores >= max(floor, 1))
            if len(able) > k:  # ties at the k-th score stay
                able = able[scores[able] >= np.partition(scores[able], -k)[-k]]
            best[i] = sorted(best[i] + [(int(scores[d]), segments[s].docs[d]) for d in able.tolist()], key=_better)[:k]


def search_index(index: DataFrame, block: Items, vocabulary: list[bytes], weights: list[int], k: int = BEST) -> DataFrame:
    """(item, doc_id, score): for every place in ``block`` the ``k`` best documents of each task's part of the index."""
    place = {term: i for i, term in enumerate(vocabulary)}
    own = [np.array([place[t] for t in terms], np.int64) for terms in block.own]
    flat, of = np.concatenate([*own, np.empty(0, np.int64)]), np.repeat(np.arange(len(own)), [len(o) for o in own])
    order = np.argsort(flat, kind="stable")
    holders = of[order], np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(vocabulary)))))
    sent = index.sparkSession.sparkContext.broadcast((own, holders, np.array(weights, np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, holders, weights = sent.value
        best: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            columns = {name: _lists(batch.column(name)) for name in ("term", "tf", "ends", "places")}
            part = lambda name, r: columns[name][0][columns[name][1][r] : columns[name][1][r + 1]]  # noqa: B023, E731
            visit([Segment(m, batch.column("docs")[r].as_py(), *(part(name, r) for name in ("term", "tf", "ends", "places")), weights) for r, m in enumerate(batch.column("m").to_pylist())], own, holders, best, k)
        found = [(i, doc, score) for i, rows_of in enumerate(best) for score, doc in rows_of]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(rows, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items``, equal scores by ascending ``doc_id``.

    Items are taken in blocks, each in one pass over all documents and its own index of the terms it asks for; counts of documents and
    lengths cover all rows. A null or empty text of a document has no terms and is not counted, one of an item finds nothing. Rows that
    repeat a document are ranked one by one; repeated items are answered one by one; a null ``doc_id`` comes last among equals. Other
    columns are left out; empty tables give an empty result.
    """
    spark, out = docs.sparkSession, None
    for block in blocks_of_items(stage(items.select("item_id", "text"), "items")):
        vocabulary = block.vocabulary()
        counted = count_terms(docs, vocabulary)
        sums = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        holding = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most the block's terms
        weights = [weight(sums["documents"], holding.get(i, 0)) for i in range(len(vocabulary))]
        found = search_index(build_index(counted, sums["documents"], sums["length"] or 0), block, vocabulary, weights, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, item_id in enumerate(block.ids)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = stage(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked-items")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


def lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item. Nulls, ties, repeated rows and empty tables as ``search`` defines them."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS row_id, doc_id, {TERMS_SQL} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, CAST(len(terms) AS BIGINT) AS n FROM cut WHERE len(terms) > 0),
whole AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
postings AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY row_id, term),
held AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
weighed AS (SELECT item_id, asked.term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN held ON asked.term = held.term, whole),
scored AS (SELECT item_id, doc_id, row_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length)))) AS BIGINT) AS score
           FROM weighed JOIN postings USING (term) JOIN docs USING (row_id), whole GROUP BY item_id, doc_id, row_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {BEST}
"""
