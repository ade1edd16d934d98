"""Token ids in files of patched frame-of-reference blocks.

A file holds the documents of one range of ``doc_id``: the magic, then blocks of ``BLOCK`` ids, then the table of documents, the starts of
the blocks, and a trailer. A block keeps its least id, and every id's distance from it in as many bits as ``PERCENT`` of the distances
need, rounded up to one of ``WIDTHS``; the distances that need more stand in a list of exceptions with their places. Block starts give any id at one seek.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from garderobe.llm.bpe import byte_letters
from garderobe.llm.pieces import Pieces, slices
from garderobe.session import scratch_path, stage

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENT = 90
WIDTHS = (0, 4, 8, 12, 16, 20, 24, 28, 32)  # so that one or two ids fill whole bytes
HEAD = struct.Struct("<IBH")  # least id, bits, exceptions
TRAILER = struct.Struct("<QQQQQ")  # ids, documents, blocks, place of the table of documents, place of the block starts
READ_BLOCKS = 2048
MANIFEST = "shard long, file string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- blocks -----------------------------------------------------------------------------------------------------


def low_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of rows of values as bytes, little end first; two values share a byte if the width is not whole bytes."""
    if width % 8:
        wide = (values & np.uint32((1 << width) - 1)).astype("<u8")
        values, width = wide[:, ::2] | wide[:, 1::2] << np.uint64(width), width * 2
    each = np.ascontiguousarray(values.astype("<u8" if width > 32 else "<u4"))
    return each.view(np.uint8).reshape(len(values), values.shape[1], -1)[:, :, : width // 8].reshape(len(values), -1)


def from_low_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values from what ``low_bits`` made of them."""
    pair = width % 8 != 0
    step = width // 4 if pair else width // 8
    each = np.zeros((len(packed), BLOCK // 2 if pair else BLOCK, 8 if pair else 4), np.uint8)
    each[:, :, :step] = packed.reshape(len(packed), -1, step) if step else 0
    if not pair:
        return each.view("<u4")[:, :, 0]
    both = each.view("<u8")[:, :, 0]
    out = np.empty((len(packed), BLOCK), np.uint32)
    out[:, ::2], out[:, 1::2] = both & np.uint64((1 << width) - 1), both >> np.uint64(width)
    return out


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` ids each; a last short block is filled up with its least id."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    if short:
        ids = np.concatenate((ids, np.full(short, ids[len(ids) // BLOCK * BLOCK :].min(), np.uint32)))
    table = ids.reshape(-1, BLOCK)
    least = table.min(axis=1)
    far = table - least[:, None]
    bits = np.full(len(table), WIDTHS[-1])
    for width in WIDTHS[-2::-1]:
        bits[(far >= 1 << width).sum(axis=1) <= BLOCK - BLOCK * PERCENT // 100] = width
    out: list[bytes] = [b""] * len(table)
    for width in np.unique(bits).tolist():
        own = np.flatnonzero(bits == width)
        values = far[own]
        packed = low_bits(values, width)
        block, place = np.nonzero(values >= 1 << width) if width < 32 else (np.empty(0, np.int64), np.empty(0, np.int64))
        cuts = np.searchsorted(block, np.arange(len(own) + 1)).tolist()
        places, full = place.astype(np.uint8), values[block, place].astype("<u4")
        for k, row in enumerate(own.tolist()):
            at, to = cuts[k], cuts[k + 1]
            out[row] = HEAD.pack(least[row], width, to - at) + packed[k].tobytes() + places[at:to].tobytes() + full[at:to].tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    out = np.empty((len(starts), BLOCK), np.uint32)
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    raw = np.frombuffer(data, np.uint8)
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = BLOCK * width // 8
        values = from_low_bits(raw[(starts[own] + HEAD.size)[:, None] + np.arange(size)], width)
        for row, k in enumerate(own.tolist()):
            least, _, n = heads[k]
            if n:
                at = int(starts[k]) + HEAD.size + size
                values[row, raw[at : at + n]] = np.frombuffer(data, "<u4", n, at + n)
        out[own] = values + np.array([heads[k][0] for k in own.tolist()], np.uint32)[:, None]
    return out.reshape(-1)


# --- files ------------------------------------------------------------------------------------------------------


class Writer:
    """One file, written from front to back; no more than a block of ids is held back."""

    def __init__(self, sink):
        self.sink, self.at, self.rest = sink, 0, np.empty(0, np.uint32)
        self.starts, self.docs, self.sizes, self.n_ids = [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        blocks = pack_blocks(ids)
        for block in blocks:
            self.starts.append(self.at)
            self.at += len(block)
        self.sink.write(b"".join(blocks))

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs += docs
        self.sizes.append(sizes)
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> None:
        self._blocks(self.rest)
        table = self.at
        known = np.array([d is not None for d in self.docs], np.uint8)
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.packbits(known).tobytes() + np.concatenate([*self.sizes, np.empty(0, np.int64)]).astype("<i8").tobytes())
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(TRAILER.pack(self.n_ids, len(self.docs), len(self.starts), table, index))
        self.sink.close()


class Reader:
    """Documents and their ids from one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.n_ids, self.n_docs, self.n_blocks, self.table, self.index = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        self.starts = np.frombuffer(self._bytes(self.index, 8 * self.n_blocks), "<u8").astype(np.int64)
        table = self._bytes(self.table, self.index - self.table)
        flags = (self.n_docs + 7) // 8
        known = np.unpackbits(np.frombuffer(table, np.uint8, flags, 8 * self.n_docs))[: self.n_docs]
        ids = np.frombuffer(table, "<i8", self.n_docs)
        self.docs = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.sizes = np.frombuffer(table, "<i8", self.n_docs, 8 * self.n_docs + flags)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` of the file, by the block starts."""
        if first >= last:
            return np.empty(0, np.uint32)
        low, high = first // BLOCK, -(-last // BLOCK)
        begin = int(self.starts[low])
        end = int(self.starts[high]) if high < self.n_blocks else self.table
        return unpack_blocks(self._bytes(begin, end - begin), self.starts[low:high] - begin)[first - low * BLOCK : last - low * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, place in the file, number of ids and their CRC-32, document by document; long ones are read in parts."""
        held, held_from, at = np.empty(0, np.uint32), 0, 0
        for doc, size in zip(self.docs, self.sizes.tolist(), strict=True):
            crc, done = 0, 0
            while done < size:
                place = at + done
                if place >= held_from + len(held):
                    held_from = place // BLOCK * BLOCK
                    held = self.ids(held_from, min(self.n_ids, held_from + READ_BLOCKS * BLOCK))
                part = held[place - held_from : at + size - held_from]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                done += len(part)
            yield doc, at, size, crc
            at += size


# --- encoding ---------------------------------------------------------------------------------------------------

#: Characters for which lower case and composition need no look at their neighbours.
EASY = re.compile("[ \t\n\r\x0b\f\x21-\x7eÀ-įı-ž]*")
CHUNKS = re.compile("[^ \t\n\r\x0b\f]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
MARKS = frozenset(".,;:!?")


def words(chunk: str) -> Sequence[str]:
    """What ``WORDS`` finds in a chunk without white space; letters alone, or before one of the commonest marks, need no search."""
    if chunk.isalpha():
        return (chunk,)
    if chunk[-1] in MARKS and chunk[:-1].isalpha():
        return chunk[:-1], chunk[-1]
    return WORDS.findall(chunk)


class WordPairs:
    """The tokenizers library with its answers for chunks between white space kept: no token spans white space."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces = Pieces(self._chunk)

    def _chunk(self, chunk: str | tuple[str]) -> list[int]:
        if isinstance(chunk, tuple):
            return self.library.encode(chunk[0], add_special_tokens=False).ids
        out: list[int] = []
        if len(self.known) > 100_000:
            self.known.clear()
        for word in words(chunk):
            ids = self.known.get(word)
            if ids is None:  # printable ASCII stands for itself in byte letters
                letters = word if word.isascii() else "".join(map(self.letter.__getitem__, word.encode()))
                ids = self.known[word] = tuple([t.id for t in self.model.tokenize(letters)])
            out += ids
        return out

    def split(self, text: str) -> list:
        if EASY.fullmatch(text) and "<|" not in text:
            return text.lower().split()
        return [(c,) for c in CHUNKS.findall(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.documents([self.split(t) for t in texts])


@lru_cache(2)
def vocabulary(path: str) -> WordPairs:
    return WordPairs(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's ids followed by ``end``."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1


# --- Spark ------------------------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Writes the ids of all documents in ascending ``doc_id`` order, one file a task, and returns the manifest.

    The manifest (shard, file, n_docs, n_ids) is written too and names the file of the attempt that succeeded, so a lost executor
    leaves at most a file that nothing refers to. Shards ascend with ``doc_id``; null ids come first; rows with equal ids stand in the
    order of their texts. A null or empty text has the end id alone. Other columns are left out; an empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, vocab, writer, name = TaskContext.get().partitionId(), vocabulary(path), None, ""
        for batch in batches:
            ids_of_docs, done = batch.column("doc_id").to_pylist(), 0
            for run in slices(batch.column("text").to_pylist()):
                if writer is None:
                    where, at = fs.FileSystem.from_uri(folder)
                    where.create_dir(at, recursive=True)
                    name = f"ids-{shard:06d}-{uuid.uuid4().hex}.pfor"
                    writer = Writer(where.open_output_stream(posixpath.join(at, name)))
                ids, counts = with_end(*vocab.encode(run), end)
                writer.add(ids_of_docs[done : done + len(run)], counts, ids)
                done += len(run)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    sorted_docs = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return stage(sorted_docs.mapInArrow(rows, MANIFEST), "manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files of a manifest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with where.open_input_file(posixpath.join(at, file)) as source:
                    docs, starts, sizes, crcs = zip(*Reader(source).documents(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.array(starts, np.int64) + base), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = manifest.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return based.repartitionByRange(n, "shard").select("file", "base").mapInArrow(rows, ROWS)


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
