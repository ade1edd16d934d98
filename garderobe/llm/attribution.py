"""Token counts of the sections of a document, from one encoding of the whole document."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.bpe import ODD_SPACE, RUNS, SPACE_AFTER_SPACE
from garderobe.llm.pieces import Pieces, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, gap_tokens long, crossing_tokens long, section_tokens array<long>"


class ByteTokens:
    """Ids of whole texts and the bytes that each id covers."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("attribution", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.pieces = Pieces(lambda piece: self.encoding.encode_ordinary(piece[0] if isinstance(piece, tuple) else " " + piece))

    def split(self, text: str) -> list:
        """Pieces of a text whose tokens do not depend on each other; (piece,) has no space before it."""
        if not text:
            return []
        if SPACE_AFTER_SPACE.search(text):
            return [(run,) for run in ([text] if ODD_SPACE.search(text) else RUNS.findall(text))]
        first, *rest = text.split(" ")
        return [(first,), *rest] if first else rest

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.documents([self.split(t) for t in texts])


@lru_cache(2)
def tokens_of(path: str) -> ByteTokens:
    return ByteTokens(path)


def lines(text: str) -> list[tuple[int, int]]:
    """Sections for running text: its lines, without the line ends, as stretches of UTF-8 bytes."""
    spans, at = [], 0
    for line in text.encode().split(b"\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    return spans


def allocate(ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, int, int]:
    """Tokens of each section, tokens of none, and tokens that lie in more than one.

    ``ends`` are the places where tokens end; spans ascend and do not overlap. A token belongs to the section that has most of its
    bytes, of equals to the first; a token without a byte in any section is a gap token.
    """
    counts, starts = np.zeros(len(spans), np.int64), np.concatenate(([0], ends[:-1]))
    filled = [k for k, (begin, end) in enumerate(spans) if end > begin]
    if not len(ends) or not filled:
        return counts, len(ends), 0
    opens, closes = np.array(spans, np.int64)[filled].T
    place = np.array(filled)
    first = np.searchsorted(closes, starts, side="right")  # the first section that ends after the token begins
    last = np.searchsorted(opens, ends, side="left") - 1  # the last one that begins before the token ends
    inside = first == last
    np.add.at(counts, place[first[inside]], 1)
    gap = int((first > last).sum())
    crossing = 0
    for k in np.flatnonzero(first < last).tolist():
        own = np.arange(first[k], last[k] + 1)
        shared = np.minimum(closes[own], ends[k]) - np.maximum(opens[own], starts[k])
        if shared.max() > 0:
            counts[place[own[int(shared.argmax())]]] += 1
            crossing += int((shared > 0).sum() > 1)
        else:
            gap += 1
    return counts, gap, crossing


def fields(parts: dict[str, str | None], between: str = "\n") -> tuple[str, list[tuple[int, int]]]:
    """One document from named fields, and the stretch of each: for counting tokens by field."""
    text, spans = "", []
    for part in parts.values():
        text += between if spans else ""
        at = len(text.encode())
        text += part or ""
        spans.append((at, at + len((part or "").encode())))
    return text, spans


def attribute_tokens(docs: DataFrame, cut: Callable[[str], list[tuple[int, int]]] = lines, path: str | None = None) -> DataFrame:
    """Encodes every whole text once and counts the tokens of its sections.

    A row per document: all tokens, those of no section, those that cross a boundary, and the tokens of each section in order. Section
    and gap tokens add up to all tokens. A null or empty text has no tokens and one empty section; repeated rows give a row each;
    a null ``doc_id`` stays null; other columns are left out; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            n, gaps, crossings, sections = [], [], [], []
            for run in slices(batch.column("text").to_pylist()):
                ids, counts = tokens.encode(run)
                widths, at = tokens.width[ids], 0
                for text, count in zip(run, counts.tolist(), strict=True):
                    own, gap, crossing = allocate(np.cumsum(widths[at : at + count]), cut(text))
                    at += count
                    n.append(count)
                    gaps.append(gap)
                    crossings.append(crossing)
                    sections.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, gaps, crossings)), pa.array(sections, pa.list_(pa.int64()))],
                                             ["doc_id", "n_tokens", "gap_tokens", "crossing_tokens", "section_tokens"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def attribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by line of every document: each line's in order, the first line, the largest count, and all lines together."""
    counted = attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    total = F.aggregate("section_tokens", F.lit(0).cast("long"), lambda a, b: a + b)
    return counted.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), total.alias("section_tokens"), "gap_tokens", "crossing_tokens",
                          F.get("section_tokens", F.lit(0)).alias("first_section_tokens"), F.array_max("section_tokens").alias("largest_section_tokens"), F.col("section_tokens").alias("tokens_by_section"))
