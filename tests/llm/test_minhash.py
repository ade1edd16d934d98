"""Near duplicates against all pairs."""

import random

import numpy as np
import pytest

from garderobe.llm import minhash
from garderobe.llm.shingles import shingle_set

DOCS = "doc_id long, text string, component_id string"


def brute(rows, per_cent):
    """Components over all pairs of rows, word by word."""
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(d, shingles(t)) for d, t, *_ in rows]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, (a, s) in enumerate(sets):
            for b, t in sets[:i]:
                if a is not None and b is not None and s and t and 100 * len(s & t) >= per_cent * len(s | t) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(d, len(s), label[d], d is None or d == label[d]) for d, s in sets]


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "no id at all here now", "x"), (None, "no id at all here now", "x"), (5, None, "x"), (6, "", "x"), (7, " \n\t ", "x"), (8, "Short One", "x"), (9, "short one", "x"), (10, "short two", "x")]
    rows += [(11, "wide space here", "x"), (12, "wide space here", "x"), (13, "É a b c d", "x"), (14, "é a b c d", "x")]
    at = 20
    while len(rows) < n:
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 30, 120, 700]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((at, " ".join(copy), "x"))
            at += rnd.randint(1, 3)
    rows += [rows[-1], (rows[-3][0], rows[-2][1], "x"), (rows[-4][0], rows[30][1], "x")]  # a repeated row, and ids with two texts
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,per_cent", [(1, 80), (2, 85)])
def test_same_components_as_all_pairs(spark, seed, per_cent):
    rows = made(seed, 260)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), per_cent=per_cent)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, per_cent), key=repr)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Buckets of more texts than a block, none like the least one: every link is still found."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for d in range(60):
        copy = list(base)
        for _ in range(rnd.randint(3, 14)):
            copy[rnd.randrange(300)] = f"x{rnd.random()}"
        rows.append((d, " ".join(copy), "x"))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), per_cent=85)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 85))


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 5000):
        items = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        bins = minhash.sketch(items)
        assert (bins != minhash.EMPTY).all() and (minhash.sketch(items[::-1]) == bins).all()
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 900).astype(np.uint64)
        same = (minhash.sketch(a[:800]) == minhash.sketch(a[100:])).mean()
        errors.append(same - 700 / 900)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shared_items_in_bulk():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert minhash.shared_items(sets[:5], sets[5:]).tolist() == want
    assert len(shingle_set("a b c d e f")) == 2


@pytest.mark.parametrize("times", [1, 2])
def test_buckets_of_a_doubled_table(spark, times):
    """Buckets with equal ends and sizes stay apart unless they hold the same texts, also if every row is repeated."""
    rows = [(rep, bucket) for bucket, own in enumerate([(1, 5, 9), (1, 7, 9), (1, 5, 9), (4,)]) for rep in own] * times
    got = minhash.merged_buckets(spark.createDataFrame(rows, "rep long, bucket long")).collect()
    assert sorted(map(tuple, got)) == [(0, 3, 1), (1, 3, 1)]
