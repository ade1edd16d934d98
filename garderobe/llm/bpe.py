"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from garderobe.llm.pieces import Pieces, slices

VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NO_TOKEN = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary file.

    Tokens are numbered by age (bytes first, then merges in their order) while encoding. Two neighbouring tokens are compatible if
    merging their joined bytes by age would give the same two tokens; a text's tokens are the only split of it into tokens whose
    neighbours all are compatible. So the longest matches from left to right, shortened or taken back where a pair is not
    compatible, are exactly what merging gives, and each place is left at most once.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = byte_letters()
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        ids = spec["model"]["vocab"]
        letters = sorted(byte_of, key=byte_of.get)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        age = {letter: i for i, letter in enumerate(letters)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(letters))]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            whole = left + right
            if whole not in age:
                age[whole] = len(self.halves)
                self.halves.append((age[left], age[right]))
            self.joined.setdefault((age[left], age[right]), age[whole])
        tokens = list(age)
        self.text = [as_bytes(t).decode("latin-1") for t in tokens]
        self.size = [len(t) for t in self.text]
        self.id = [ids[t] for t in tokens]
        by_text = {t: i for i, t in enumerate(self.text)}
        self.whole = by_text
        self.shorter = [next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), NO_TOKEN) for t in self.text]
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.matcher.add_word(t, i)
        self.matcher.make_automaton()
        self.compatible = lru_cache(1 << 19)(self._compatible)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        blob = {i: as_bytes(t) for t, i in ids.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.blob = np.frombuffer(b"".join(blob.get(i, b"") for i in range(max(blob) + 1)), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(blob.get(i, b"")) for i in range(max(blob) + 1)])))
        self.words = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, list[int]] = {}
        self.pieces = Pieces(self._piece)

    def _compatible(self, left: int, right: int) -> bool:
        """Walks down the seam of two tokens, youngest half first: a merge across it that is older than the halves would come first."""
        before = len(self.halves)
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            if left > right:
                before, left = left, self.halves[left][1]
                if left == before:
                    before, right = right + 1, self.halves[right][0]
                    if right + 1 == before:
                        return True
            else:
                before, right = right + 1, self.halves[right][0]
                if right + 1 == before:
                    before, left = left, self.halves[left][1]
                    if left == before:
                        return True

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as one Latin-1 character per byte."""
        if (whole := self.whole.get(word)) is not None:
            return [self.id[whole]]
        longest = [0] * len(word)
        for end, token in self.matcher.iter(word):
            longest[end + 1 - self.size[token]] = token
        open_at, taken, at = [True] * (len(word) + 1), [], 0
        token = longest[0]
        while at < len(word):
            while token != NO_TOKEN and not (open_at[at + self.size[token]] and (not taken or self.compatible(taken[-1], token))):
                token = self.shorter[token]
            if token == NO_TOKEN:
                open_at[at] = False
                token = taken.pop()
                at -= self.size[token]
                continue
            taken.append(token)
            at += self.size[token]
            token = longest[at] if at < len(word) else NO_TOKEN
        return [self.id[t] for t in taken]

    def _piece(self, piece: str | tuple) -> list[int]:
        if isinstance(piece, tuple):
            if len(piece) == 2:
                return [piece[1]]
            text = piece[0]
        else:
            text = " " + piece
        out: list[int] = []
        if len(self.known) > 100_000:
            self.known.clear()
        for word in self.words.findall(text):
            ids = self.known.get(word)
            if ids is None:
                ids = self.known[word] = self.word(word.encode().decode("latin-1"))
            out += ids
        return out

    def split(self, text: str) -> list:
        """Pieces whose tokens do not depend on each other: a text may be cut wherever white space follows something else.

        A plain string stands for itself after a space, (string,) for itself, (string, id) for a special token.
        """
        if self.special_split and "<|" in text and len(parts := self.special_split.split(text)) > 1:
            return [p for i, part in enumerate(parts) if part for p in ([(part, self.special[part])] if i % 2 else self.plain(part))]
        return self.plain(text) if text else []

    def plain(self, text: str) -> list:
        if SPACE_AFTER_SPACE.search(text):
            runs = [text] if ODD_SPACE.search(text) else RUNS.findall(text)
            return [r[1:] if r[0] == " " and len(r) > 1 else (r,) for r in runs]
        pieces = text.split(" ")
        pieces[0] = (pieces[0],)
        return pieces

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        return self.pieces.documents([self.split(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: every id's stretch of the table of all tokens' bytes."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        upto = np.cumsum(sizes)
        return self.blob[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)].tobytes()


SPACE_AFTER_SPACE = re.compile(r"\s ")
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
RUNS = re.compile("[ \t\n\r\x0b\f]*[^ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+")


@lru_cache(2)
def vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


def lossy(data: bytes) -> bytes:
    """Bytes that are not UTF-8 become U+FFFD; texts that were encoded whole have none."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, if asked) for every row of ``docs``.

    A null or empty text has no tokens and decodes to the empty text. Repeated rows each give a row; a null ``doc_id`` stays null;
    other columns are left out, whatever their names. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n, hashes, decoded, kept = [], [], [], []
            for run in slices(batch.column("text").to_pylist()):
                ids, counts = vocab.encode(run)
                at = 0
                for count in counts.tolist():
                    own = ids[at : at + count]
                    at += count
                    back = lossy(vocab.decode(own))
                    n.append(count)
                    hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        kept.append(own.astype(np.int32))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
