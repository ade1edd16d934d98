"""Alignment against whole encodings and a plain version of the counts."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from garderobe.llm import alignment
from garderobe.llm.bpe import byte_letters
from tests.llm.conftest import odd_rows


def plain(docs):
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    byte_of, out, count = byte_letters(), [], Counter()
    for doc, text in docs:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        of_a = [bytes(byte_of[c] for c in a_side.id_to_token(t)) for t in a]
        of_b = [bytes([int(b_side.id_to_piece(t)[3:5], 16)]) if b_side.is_byte(t) else b_side.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            out.append((doc, [], [], [], []))
            continue
        spans = []
        for side in (of_a, of_b):
            at, own = 0, []
            for t in side:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        group_of = {cut: ([], []) for cut in cuts}
        for side, (ids, own) in enumerate(zip((a, b), spans, strict=True)):
            for t, (_, e) in zip(ids, own, strict=True):
                group_of[cuts[bisect_left(cuts, e)]][side].append(t)
        groups = list(group_of.values())
        j, links = 0, []
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < y:
                links.append((a[i], b[k]))
                k += 1
        count.update(links)
        out.append((doc, a, b, groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return sorted(((doc, len(a), len(b), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest(g)) for doc, a, b, g, links in out), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


MORE = ["a  b   c ", " a ", "  ", "a ", "a▁b", "▁ x", "trailing   ", "tab\t x\n y \n\n z", "nb\xa0sp　wide  em", "\x1c x\x1f y", "日本語 のテキスト、絵文字🙂🙂 zusammen", "é é", "<0x0A> <s> </s> <unk> <|endoftext|>x", "'s 'tis we'll 1234567890", "\x00 nul"]


@pytest.mark.parametrize("head", [0, 40, 1 << 17])
def test_odd_tables(spark, odd, head):
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string")
    aligned = alignment.align_documents(odd.select("doc_id", "text").unionByName(extra))
    got = rows(alignment.with_counts(aligned, alignment.pair_counts(aligned), head))
    assert got == plain([(r[0], r[1]) for r in odd_rows()] + [(900 + i, t) for i, t in enumerate(MORE)])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(alignment.alignment_query(spark, folder)) == plain(docs)


def test_empty_and_extra_columns(spark, odd, no_docs):
    assert alignment.alignment(no_docs).collect() == []
    renamed = odd.withColumnRenamed("kept", "row").withColumnRenamed("score", "pairs").withColumnRenamed("n_words", "times")
    assert rows(alignment.alignment(renamed)) == rows(alignment.alignment(odd))


def test_leaves_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        whole = rng.randint(1, 40)
        a, b = (sorted({*rng.sample(range(1, whole + 1), rng.randint(1, whole)), whole}) for _ in range(2))
        leaves = alignment.groups_of(a, b, (0, len(a), 0, len(b)))
        assert [a[x[1] - 1] for x in leaves] == sorted(set(a) & set(b)) == [b[x[3] - 1] for x in leaves]
        assert all(x[1] == y[0] and x[3] == y[2] for x, y in zip(leaves, leaves[1:], strict=False))
        overlapping = {(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])}
        assert {p for leaf in leaves for p in alignment.links_of(a, b, leaf)} == overlapping


def test_cut_nearest_to_the_middle():
    a = list(range(1, 11))
    assert alignment.shared_cut(a, [1, 6, 10], 0, 10, 0, 3) == (6, 2) and alignment.shared_cut(a, [10], 0, 10, 0, 1) is None


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "PIECES", 3)
    pieces = alignment.AlignedPieces(alignment.TwoTokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    whole = [pieces.align([t])[2] for t in ("one two three four", "five six seven", "one two three four")]
    assert whole[0] == whole[2] and len(pieces) <= 7


def test_texts_without_tokens_between_others():
    pieces = alignment.AlignedPieces(alignment.TwoTokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    for text in ("", "a▁b"):  # a caller holds what it got while it asks for more
        n, links, said = pieces.align([f"one {text}x", text, "two three"])
        more = pieces.align([f"four five {text or 'six'} seven", "eight"])
        assert said[1] is None and not len(links[1]) and not n[1].any() and said[2] and more[2][1]
