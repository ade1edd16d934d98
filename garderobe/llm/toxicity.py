"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from garderobe.llm.pieces import Pieces, slices

SAMPLE = 4_000  # most labelled texts of each class that the model is fitted on
BUCKETS = 1 << 24  # terms are hashed into so many places each for words and for beginnings of words
BEGINNING = 1 << 30  # marks the places of beginnings
MOST_TERMS = 20_000  # most terms that separate the classes on their own: with their factors they bound what is sent to every executor
LEAST_DOCS, LEAST_Z = 3, 3.0  # a term is learned if so many texts have it and the classes differ in it so clearly
PAIR_TERMS = 2048  # words whose pairs are looked at: the most frequent of those that can be in a clear pair
PAIR_Z = 6.0  # a pair is one of a million: so clearly must the classes differ in it, and by LEAST_Z more than in either of its terms
PAIR_CHANCE = 2e-9  # the same for pairs of few texts, where z says too much: the chance that all of them are of one class
BLOCK = 512  # terms of which all pairs are counted at once
PREFIXES = (3, 4, 5, 6, 7, 8)
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 15, 64, 0.1, 1e-4
CUT = 0.7
SEED = 6
LETTERS = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, score double"


def terms_of(chunk: bytes) -> list[int]:
    """Places of the words in a chunk without white space, and of their first letters: word families share them."""
    out = []
    for word in LETTERS.findall(chunk.decode(errors="replace").lower()):
        out.append(xxhash.xxh32_intdigest("=" + word) % BUCKETS)
        out += [xxhash.xxh32_intdigest(word[:k]) % BUCKETS + BEGINNING for k in PREFIXES if len(word) > k]
    return out


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors), each term of a text once."""

    terms: np.ndarray  # sorted places
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, own: np.ndarray) -> float:
        """``own``: places in ``terms``, each once."""
        v = self.factors[own]
        return float(self.bias + self.weights[own].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(own), -30, 30))))


def separation(of_toxic: np.ndarray, with_: np.ndarray, n1: int, n: int) -> np.ndarray:
    """How clearly the classes differ in how often a thing occurs: the z of two shares."""
    share = with_ / n
    return np.abs(of_toxic / n1 - (with_ - of_toxic) / (n - n1)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))


def members_of_pairs(terms: np.ndarray, place: np.ndarray, of: np.ndarray, labels: np.ndarray, with_: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Which words are in a pair that separates the classes more clearly than either word does.

    ``place`` and ``of``: the term and the text of every occurrence. All pairs are counted of at most ``PAIR_TERMS`` words, the most frequent
    of those that can be in such a pair: with fewer texts than ``least`` in all, no distribution over the classes is as clear as ``PAIR_Z``
    and ``PAIR_CHANCE`` ask. So the work is bounded by the sample, whatever the vocabulary.
    """
    n, n1 = len(labels), int(labels.sum())
    rare = np.arange(1, min(n1, n - n1) + 1)
    able = separation(rare if n1 <= n - n1 else np.zeros(len(rare)), rare, n1, n) >= PAIR_Z
    least = max(int(rare[able.argmax()]) if able.any() else len(rare) + 1, int(np.ceil(np.log(PAIR_CHANCE) / np.log(min(n1, n - n1) / n))))
    common = np.flatnonzero((with_ >= least) & (terms < BEGINNING))
    common = np.sort(common[np.argsort(-with_[common], kind="stable")[:PAIR_TERMS]])
    column = np.full(len(with_), -1, np.int32)
    column[common] = np.arange(len(common))
    at = column[place]
    has = np.zeros((n, len(common)), np.uint8)
    has[of[at >= 0], at[at >= 0]] = 1
    found, toxic, z = np.zeros(len(common), bool), labels == 1, alone[common]
    for i in range(0, len(common), BLOCK):
        one = np.ascontiguousarray(has[:, i : i + BLOCK].T, np.float32)
        one_toxic = np.ascontiguousarray(one[:, toxic])
        for j in range(i, len(common), BLOCK):
            other = has[:, j : j + BLOCK].astype(np.float32)
            both, of_toxic = one @ other, one_toxic @ other[toxic]
            clear = (both >= least) & (separation(of_toxic, both, n1, n) >= np.maximum(PAIR_Z, np.maximum(z[i : i + BLOCK, None], z[None, j : j + BLOCK]) + LEAST_Z))
            found[i : i + BLOCK] |= clear.any(axis=1)
            found[j : j + BLOCK] |= clear.any(axis=0)
    return common[found]


def chosen_terms(flat: np.ndarray, of: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Terms that separate the classes, the clearest first to be kept, and those that do so in a pair. ``of``: the text of every term in ``flat``."""
    terms = np.unique(flat)
    place = np.searchsorted(terms, flat).astype(np.int32)
    with_, of_toxic = np.bincount(place, minlength=len(terms)), np.bincount(place[labels[of] == 1], minlength=len(terms))
    z = separation(of_toxic, with_, int(labels.sum()), len(labels))
    fit = np.flatnonzero((with_ >= LEAST_DOCS) & (z >= LEAST_Z))
    return terms[np.union1d(fit[np.argsort(-z[fit], kind="stable")[:MOST_TERMS]], members_of_pairs(terms, place, of, labels, with_, z))]


def fit(texts: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, terms: np.ndarray | None = None) -> Machine:
    """Fits on texts given one by one, each by its distinct terms."""
    return fit_flat(np.concatenate([*texts, np.empty(0, np.int32)]).astype(np.int32), np.array([len(t) for t in texts], np.int64), labels, factors, terms)


def fit_flat(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, factors: int = FACTORS, terms: np.ndarray | None = None) -> Machine:
    """Fits by AdaGrad on the logistic loss in small batches; the classes weigh alike. ``flat``: distinct terms of all texts in a row, ``sizes``
    of each text.

    With a class missing there is nothing to learn: the score is the share of toxic texts everywhere.
    """
    n1 = int(labels.sum())
    if n1 in (0, len(labels)):
        rate = (n1 + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        return Machine(np.empty(0, np.int32), float(np.log(rate / (1 - rate))), np.empty(0), np.empty((0, factors)))
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    terms = chosen_terms(flat, of, labels) if terms is None else terms
    place = np.minimum(np.searchsorted(terms, flat), max(0, len(terms) - 1))
    known = terms[place] == flat if len(terms) else np.zeros(len(flat), bool)
    ends = np.cumsum(np.bincount(of[known], minlength=len(sizes)))
    rows = np.split(place[known], ends[:-1])
    rng = np.random.default_rng(SEED)
    w, v, bias = np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors)), 0.0
    sums_w, sums_v, sum_b = np.full(len(terms), 1e-8), np.full((len(terms), factors), 1e-8), 1e-8
    weight = np.where(labels == 1, len(labels) / (2 * n1), len(labels) / (2 * (len(labels) - n1)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            own = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            total = np.zeros((len(batch), factors))
            np.add.at(total, of, v[own])
            linear, squares = np.bincount(of, w[own], len(batch)), np.bincount(of, (v[own] ** 2).sum(axis=1), len(batch))
            margin = bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)
            slope = weight[batch] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            touched, back = np.unique(own, return_inverse=True)
            grad_w = np.bincount(back, slope[of], len(touched)) + DECAY * w[touched]
            grad_v = np.zeros((len(touched), factors))
            np.add.at(grad_v, back, slope[of, None] * (total[of] - v[own]))
            grad_v += DECAY * v[touched]
            sums_w[touched] += grad_w**2
            sums_v[touched] += grad_v**2
            sum_b += slope.sum() ** 2
            w[touched] -= RATE * grad_w / np.sqrt(sums_w[touched])
            v[touched] -= RATE * grad_v / np.sqrt(sums_v[touched])
            bias -= RATE * slope.sum() / np.sqrt(sum_b)
    return Machine(terms, float(bias), w, v)


class Scorer:
    """Scores texts with one machine; what a chunk of text has of its terms is kept."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.at = {term: at for at, term in enumerate(machine.terms.tolist())}
        self.pieces = Pieces(self._known)
        self.none = machine.score(np.empty(0, np.int64))

    def _known(self, chunk: bytes) -> list[int]:
        return [at for term in terms_of(chunk) if (at := self.at.get(term)) is not None]

    def scores(self, texts: list[str]) -> list[float]:
        own, counts = self.pieces.documents([t.encode().lower().split() for t in texts])
        ends = np.cumsum(counts)
        return [self.machine.score(np.unique(own[e - c : e])) if c else self.none for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


_SCORER: dict[str, Scorer] = {}  # the last machine that this worker has scored with


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on a sample of at most ``SAMPLE`` texts of each class, by hash of the id, none of which is held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").cast("int").alias("_toxic")).filter("_doc is not null and _toxic in (0, 1)").filter(~held_out(F.col("_doc")))
    known = known.groupBy("_doc").agg(F.max("_toxic").alias("_toxic"))
    sizes = {row["_toxic"]: row["count"] for row in known.groupBy("_toxic").count().collect()}
    share = F.when(F.col("_toxic") == 1, min(1.0, SAMPLE / max(1, sizes.get(1, 0)))).otherwise(min(1.0, SAMPLE / max(1, sizes.get(0, 0))))
    # About 2 x SAMPLE ids at most, whatever the tables hold: small enough for every executor, so that no text is shuffled to find them.
    sample = known.filter(F.pmod(F.xxhash64("_doc"), F.lit(1_000_000)) < share * 1_000_000)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.unique(np.array([t for chunk in set((text or "").encode().lower().split()) for t in terms_of(chunk)], np.int32)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_toxic"), pa.array(terms, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_doc")).select("_doc", "_toxic", "text")
    one_each = texts.mapInArrow(rows, "doc_id long, toxic int, terms array<int>").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))  # an id has one text, however often it occurs
    table = one_each.orderBy("doc_id").toArrow()  # in order, so that reruns fit the same machine
    lists = table.column("terms").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    ends = lists.offsets.to_numpy().astype(np.int64)
    return fit_flat(lists.values.to_numpy()[ends[0] : ends[-1]] if len(lists) else np.empty(0, np.int32), np.diff(ends), table.column("toxic").to_numpy().astype(np.int64))


def with_score(docs: DataFrame, machine: Machine, name: str = "score", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text, if it is not to be kept) and the score of every row's text."""
    sent, model = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _SCORER:
            _SCORER.clear()
            _SCORER[model] = Scorer(sent.value)
        for batch in batches:
            scores = [s for run in slices(batch.column("text").to_pylist()) for s in _SCORER[model].scores(run)]
            yield (batch if keep_text else batch.drop_columns(["text"])).append_column(name, pa.array(scores, pa.float64()))

    kept = docs.schema if keep_text else docs.drop("text").schema
    ordered = docs.drop(name) if name in docs.columns else docs
    return ordered.mapInArrow(rows, StructType([f for f in kept if f.name != name] + [StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``CUT`` on) of every row of ``docs``.

    Labels are learned from rows that are not held out; the text alone is scored. Labels of unknown documents, null labels and labels
    other than 0 and 1 teach nothing; a document labelled twice counts as toxic if either says so. A null ``doc_id`` is scored and not
    held out. Without labels of both classes the score is the share of toxic ones, 0.5 without any. An empty table gives an
    empty result; other columns are left out.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels), keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
