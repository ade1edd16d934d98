"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Places where a token of either side ends are shared cuts. A text is divided at a shared cut near its middle, found by bisection, and so
are both halves; a stretch without a shared cut inside is a leaf: a group of tokens that only belong together as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.bpe import byte_letters
from garderobe.llm.pieces import Pieces, slices
from garderobe.session import stage

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"  # stands for a space in pieces of B
BASE = 1 << 31  # a pair of ids as one number: A's id times this, and B's id
PIECES, PIECE_CHARS = 300_000, 20_000_000  # what a worker remembers of aligned pieces; then it starts anew, which changes no result
HEAD = 1 << 17  # most pairs whose counts are sent to every executor
CUT = re.compile(r"(?<=\S) ")  # a space after something else: neither tokenizer has a token across the place before it
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
COUNTED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"


def shared_cut(a: Sequence[int], b: Sequence[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """Of A's tokens a0 to a1 and B's b0 to b1: how many lie before the common end nearest to the middle of A's; None without one inside."""
    middle = (a0 + a1 - 2) // 2
    for away in range(a1 - a0):
        for i in (middle - away, middle + away + 1):
            if a0 <= i < a1 - 1:
                j = bisect_left(b, a[i], b0, b1 - 1)
                if j < b1 - 1 and b[j] == a[i]:
                    return i + 1, j + 1
    return None


def groups_of(a: Sequence[int], b: Sequence[int], whole: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """Leaves in order, as stretches (a0, a1, b0, b1) of tokens; ``a`` and ``b`` are the places where tokens end, which agree at the end of ``whole``."""
    leaves, open_ = [], [whole]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        cut = shared_cut(a, b, a0, a1, b0, b1) if a1 - a0 > 1 and b1 - b0 > 1 else None
        if cut is None:
            leaves.append((a0, a1, b0, b1))
        else:
            open_ += [(cut[0], a1, cut[1], b1), (a0, cut[0], b0, cut[1])]
    return leaves


def links_of(a: Sequence[int], b: Sequence[int], leaf: tuple[int, int, int, int]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of a leaf's tokens whose bytes overlap."""
    i, a1, j, b1 = leaf
    while i < a1 and j < b1:
        yield i, j
        i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])


class TwoTokenizers:
    """Ids of pieces of text by both tokenizers. A piece is what follows a space: the space belongs to it."""

    def __init__(self, path_a: str, path_b: str):
        byte_of = byte_letters()
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}  # their strings in a text are ordinary text
        tokens = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})  # ids ascend with the merges
        self.bytes_a = {i: token for token, i in tokens.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.cut = None if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names) else CUT
        self.space = self.b.piece_to_id(SPACE)

    def split(self, text: str) -> list[str]:
        return (self.cut.split(text) if self.cut else [text]) if text else []

    def encode(self, piece: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """Ids of a space and ``piece`` by A and B, and where they end; None if the bytes of either side are not those of the piece."""
        a = self.a.encode_ordinary(" " + piece)
        b = self.b.encode(piece, num_threads=1) if piece else [self.space]  # B puts the space there itself, but not before nothing
        of_a, of_b, whole = [self.bytes_a[t] for t in a], [self.bytes_b[t] for t in b], (" " + piece).encode()
        return (a, b, list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))) if b"".join(of_a) == whole == b"".join(of_b) else None


class AlignedPieces(Pieces):
    """piece -> row of a table: its links, its numbers of tokens and groups, its groups as text. Every distinct piece is aligned once."""

    def __init__(self, two: TwoTokenizers):
        self.two = two
        super().__init__(two.encode)

    def forget(self) -> None:
        self.clear()
        self.links, self.ends, self.sizes, self.texts, self.chars = array("q"), array("q", [0]), array("q"), [], 0

    def _add(self, piece: str, text: str | None, sizes: tuple[int, int, int]) -> None:
        self.sizes.extend(sizes)
        self.ends.append(len(self.links))
        self.chars += len(piece) + len(text or "")
        self[piece] = len(self.texts)
        self.texts.append(text)

    def _align(self, piece: str, a: list[int], b: list[int], ends_a: list[int], ends_b: list[int], whole: tuple[int, int, int, int]) -> None:
        leaves = groups_of(ends_a, ends_b, whole)
        said = []
        for leaf in leaves:
            a0, a1, b0, b1 = leaf
            if a1 - a0 == 1 and b1 - b0 == 1:
                self.links.append(a[a0] * BASE + b[b0])
                said.append(f"{a[a0]}|{b[b0]}")
            else:
                self.links.extend([a[i] * BASE + b[j] for i, j in links_of(ends_a, ends_b, leaf)])
                said.append(",".join(map(str, a[a0:a1])) + "|" + ",".join(map(str, b[b0:b1])))
        self._add(piece, ";".join(said), (whole[1] - whole[0], whole[3] - whole[2], len(leaves)))

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces that are new. Most are encoded as one text, whose shared cuts between the pieces are known beforehand."""
        joint = [p for p in pieces if p and SPACE not in p and not p[-1].isspace()] if self.two.cut else []
        if len(joint) > 1 and (got := self.two.encode(" ".join(joint))):
            ends_a, ends_b = np.array(got[2]), np.array(got[3])
            bounds = np.cumsum([len(p.encode()) + 1 for p in joint])
            at_a, at_b = np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)
            if (ends_a[at_a] == bounds).all() and (ends_b[at_b] == bounds).all():
                a0 = b0 = 0
                for piece, a1, b1 in zip(joint, (at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
                    self._align(piece, *got, (a0, a1, b0, b1))
                    a0, b0 = a1, b1
        for piece in pieces:
            if piece not in self:
                got = self.two.encode(piece)
                if got:
                    self._align(piece, *got, (0, len(got[0]), 0, len(got[1])))
                else:
                    self._add(piece, None, (0, 0, 0))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[str | None]]:
        """Of every text: (tokens of A, of B, groups), its links, and its groups as text; None for a text without tokens."""
        if Pieces.in_use is not self:
            if Pieces.in_use is not None:
                Pieces.in_use.forget()
            Pieces.in_use = self
        if len(self) > PIECES or self.chars > PIECE_CHARS:
            self.forget()
        split = [self.two.split(t) for t in texts]
        self.learn([p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self])
        sizes, links, said = np.zeros((len(texts), 3), np.int64), [], []
        ends, table, known = np.frombuffer(self.ends, np.int64), np.frombuffer(self.links, np.int64), np.frombuffer(self.sizes, np.int64).reshape(-1, 3)
        for k, own in enumerate(split):
            rows = list(map(self.__getitem__, own))
            groups = [self.texts[r] for r in rows]
            if not rows or None in groups:
                links.append(np.zeros(0, np.int64))  # not a part of ``table``: what the caller keeps would hold it, and the next text could not be added
                said.append(None)
                continue
            at = np.array(rows)
            start, n = ends[at], ends[at + 1] - ends[at]
            upto = np.cumsum(n)
            links.append(table[np.arange(upto[-1]) + np.repeat(start - upto + n, n)])
            sizes[k] = known[at].sum(axis=0)
            said.append(";".join(groups))
        return sizes, links, said


@lru_cache(2)
def pieces_of(path_a: str, path_b: str) -> AlignedPieces:
    return AlignedPieces(TwoTokenizers(path_a, path_b))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row per document with its numbers of tokens, groups and links, the digest of its groups, and its distinct pairs of linked ids.

    ``pairs`` holds A's id times ``BASE`` and B's id, ``times`` how many links of the document have the pair. Written to the shared folder;
    ``row`` numbers the rows. A null or empty text, and one that either tokenizer does not give back, has no tokens.
    """
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = pieces_of(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, done = batch.column("doc_id").cast(pa.int64()), 0
            for run in slices(batch.column("text").to_pylist()):
                n, links, said = pieces.align(run)
                distinct = [np.unique(own, return_counts=True) for own in links]
                digests = [hashlib.sha256(groups.encode()).hexdigest() if groups else "" for groups in said]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(run)), pa.int64()), doc_ids.slice(done, len(run)), *(pa.array(n[:, k]) for k in range(3)), pa.array(map(len, links), pa.int64()), pa.array(digests, pa.string()),
                                                  *(pa.array([d[k] for d in distinct], pa.list_(pa.int64())) for k in range(2))], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row, done = row + len(run), done + len(run)

    return stage(docs.select("doc_id", "text").mapInArrow(rows, ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, total, is_best): links of all documents that have the pair, and whether no pair with the same B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total"))
    totals = stage(each, "pair-totals")
    b = F.col("pair") % BASE
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return stage(totals.join(most, b == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("is_best")), "pair-counts")


def with_counts(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """Adds n_best and count_sum. The most frequent pairs, ``head`` at most, are looked up in every task; only the others are joined."""
    sizes = {r["power"]: r["n"] for r in counts.groupBy(F.floor(F.log2("total")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a power of two
    least, known = 63, 0
    while least and known + sizes.get(least - 1, 0) <= head:
        least -= 1
        known += sizes.get(least, 0)
    often = F.floor(F.log2("total")).cast("int") >= least
    table = counts.filter(often).toArrow() if known else pa.table({"pair": pa.array([], pa.int64()), "total": pa.array([], pa.int64()), "is_best": pa.array([], pa.bool_())})
    order = np.argsort(table.column("pair").to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast((table.column("pair").to_numpy()[order], table.column("total").to_numpy()[order], table.column("is_best").to_numpy(zero_copy_only=False)[order]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, total, best = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            pairs, times = batch.column("pairs").values.to_numpy()[ends[0] : ends[-1]], batch.column("times").values.to_numpy()
            ends_t = batch.column("times").offsets.to_numpy()
            times, ends = times[ends_t[0] : ends_t[-1]], ends - ends[0]
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            met = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(count_sum, of[met], times[met] * total[at[met]])
            chosen = met.copy()
            chosen[met] = best[at[met]]
            np.add.at(n_best, of[chosen], times[chosen])
            left = np.concatenate(([0], np.cumsum(np.bincount(of[~met], minlength=batch.num_rows)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~met])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:7]), pa.array(n_best), pa.array(count_sum), *rest], [*batch.schema.names[:7], "n_best", "count_sum", "pairs", "times"])

    counted = stage(aligned.mapInArrow(rows, COUNTED), "often")
    rest = counted.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("row").alias("_row"), F.col("p.pairs").alias("_pair"), F.col("p.times").alias("_times"))
    met = rest.join(counts.filter(~often), F.col("_pair") == F.col("pair"))
    more = met.groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("_times") * F.col("total")).alias("_sum"))
    plus = lambda name, other: (F.col(name) + F.coalesce(F.col(other), F.lit(0))).alias(name)
    return counted.join(more, F.col("row") == F.col("_row"), "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A null or empty text and one that a tokenizer does not give back byte by byte have zeros and an empty digest. Repeated rows give a row
    each and count each; a null ``doc_id`` stays null; pairs that tie for a B id are all its best. Other columns are left out, whatever
    their names; an empty table gives an empty result.
    """
    aligned = align_documents(docs, path_a, path_b)
    return with_counts(aligned, pair_counts(aligned))


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned. Nulls, ties, repeated rows and empty tables as ``alignment`` defines them."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
