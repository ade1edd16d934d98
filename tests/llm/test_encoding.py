"""Encoders against the libraries themselves, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from garderobe.llm import attribution, bpe, token_files
from tests.llm.conftest import odd_rows

LETTERS = " \t\n  ab'sTHEÉé　\x85\x1c日本🙂<|endoftext|>.,!!12́\x0b\rİΣŉſß×"


def odd_texts(n=1500):
    rnd = random.Random(3)
    return [r[1] or "" for r in odd_rows()] + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("module,vocabulary", [(bpe, bpe.VOCABULARY), (token_files, token_files.VOCABULARY)])
def test_ids_as_the_library(module, vocabulary):
    path = public_tokenizers.path(vocabulary)
    library, own, texts = Tokenizer.from_file(path), module.vocabulary(path), odd_texts()
    ids, counts = own.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part, want in zip(texts, parts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert part.tolist() == want.ids, text[:80]


def test_decoding_returns_the_text():
    own = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    for text in odd_texts(200):
        assert own.decode(own.encode([text])[0]).decode() == text


def test_pieces_start_anew_when_full(monkeypatch):
    monkeypatch.setattr("garderobe.llm.pieces.LIMIT", 5)
    own, library = bpe.BytePairs(public_tokenizers.path(bpe.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    for text in ("a b c d e f g h", "h g f e a", "new words again"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(odd, no_docs):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for doc, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_documents(odd).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(no_docs).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for high in (1, 2, 16, 255, 5000, 70000, 2**21, 2**32 - 1):
        for n in (0, 1, 255, 256, 257, 3000):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            ids[::37] = rng.integers(0, 2**32 - 1, len(ids[::37]), dtype=np.uint32)
            blocks = token_files.pack_blocks(ids)
            assert (token_files.unpack_blocks(b"".join(blocks), np.cumsum([0] + [len(b) for b in blocks])[:-1].astype(np.int64))[:n] == ids).all()


def test_token_files(odd, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "READ_BLOCKS", 2)
    manifest = token_files.write_ids(odd, str(tmp_path / "a"))
    got = [tuple(r) for r in token_files.read_ids(manifest, str(tmp_path / "a")).collect()]
    library, start, want = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)), 0, []
    for doc, text, *_ in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_ids(token_files.write_ids(no_docs, str(tmp_path / "b")), str(tmp_path / "b")).collect() == []


def test_any_stretch_of_a_file(tmp_path):
    rng = np.random.default_rng(2)
    ids, path = rng.integers(0, 60000, 5000, dtype=np.uint32), tmp_path / "f"
    with open(path, "wb") as sink:
        writer = token_files.Writer(sink)
        writer.add([1, None], np.array([3000, 10]), ids[:3010])
        writer.add([2], np.array([1990]), ids[3010:])
        writer.close()
    import pyarrow as pa

    reader = token_files.Reader(pa.OSFile(str(path)))
    assert reader.docs == [1, None, 2] and (reader.ids(700, 4111) == ids[700:4111]).all() and not len(reader.ids(5, 5))


def counted_by_hand(encoding, text):
    """Byte by byte: which token has it, which line has it."""
    tokens, data = encoding.encode_ordinary(text), text.encode()
    line_of, line = [], 0
    for byte in data:
        line_of.append(None if byte == 10 else line)
        line += byte == 10
    counts, gap, crossing, at = [0] * (line + 1), 0, 0, 0
    for token in tokens:
        size = len(encoding.decode_single_token_bytes(token))
        lines = [x for x in line_of[at : at + size] if x is not None]
        at += size
        if lines:
            counts[min(set(lines), key=lambda x: (-lines.count(x), x))] += 1
            crossing += len(set(lines)) > 1
        else:
            gap += 1
    return len(tokens), gap, crossing, counts


def test_attribution_by_hand(odd, no_docs):
    encoding = attribution.tokens_of(public_tokenizers.path(attribution.VOCABULARY)).encoding
    assert isinstance(encoding, tiktoken.Encoding)
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000]
    want = [(r[0], *counted_by_hand(encoding, r[1] or "")) for r in rows]
    got = attribution.attribute_tokens(odd.filter("length(text) < 5000 or text is null")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert attribution.attribute_tokens(no_docs).collect() == []
    for text in odd_texts(300):
        tokens = attribution.tokens_of(public_tokenizers.path(attribution.VOCABULARY))
        ids, _ = tokens.encode([text])
        counts, gap, crossing = attribution.allocate(np.cumsum(tokens.width[ids]), attribution.lines(text))
        if len(text) < 5000:
            assert (len(ids), gap, crossing, counts.tolist()) == counted_by_hand(encoding, text)


def test_boundary_rule():
    ends = np.array([4, 8, 12])
    assert attribution.allocate(ends, [(0, 6), (6, 12)])[0].tolist() == [2, 1]  # two bytes each: the first section
    assert attribution.allocate(ends, [(0, 5), (5, 12)])[0].tolist() == [1, 2]
    assert attribution.allocate(ends, [(5, 7)]) [1:] == (2, 0)
    text, spans = attribution.fields({"title": "A title", "body": None, "foot": "é"})
    assert text == "A title\n\né" and spans == [(0, 7), (8, 8), (9, 11)]


def test_attribution_query_gives_every_line(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokens = attribution.tokens_of(public_tokenizers.path(attribution.VOCABULARY))
    rows = attribution.attribution_query(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_sections > 2 for r in rows)
    for r in rows:
        ids = tokens.encode([texts[r.doc_id] or ""])[0]
        assert r.tokens_by_section == attribution.allocate(np.cumsum(tokens.width[ids]), attribution.lines(texts[r.doc_id] or ""))[0].tolist()
        assert sum(r.tokens_by_section) == r.section_tokens and len(r.tokens_by_section) == r.n_sections


def test_words_of_a_chunk_as_the_pattern_finds_them():
    odd = ["word", "Žluť", "word.", "été,", "it's", "'s", "s'", ".", "..", "a..", "a1", "1.", "x²", "don't!", "a:b", "naïve?!", "×", "×."]
    assert [list(token_files.words(c)) for c in odd] == [token_files.WORDS.findall(c) for c in odd]
