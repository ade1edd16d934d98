"""Shards: groups stay together, bytes are even, slots have no gaps; differencing against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from garderobe.llm import sharding
from tests.llm.conftest import odd_rows


def plain_differencing(weights, slots):
    """The same rule with sets of members in place of numbers."""
    parts = [(k, sorted([(w, k, (k,))] + [(0, -1, ())] * (slots - 1))) for k, w in enumerate(weights)]
    serial = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][0][0] - p[1][-1][0], p[0]))
        (_, one), (_, other) = parts[:2]
        parts = parts[2:] + [(serial, sorted((a[0] + b[0], -1, tuple(sorted(a[2] + b[2]))) for a, b in zip(one, reversed(other))))]
        serial += 1
    return sorted(s[0] for s in parts[0][1])


def test_against_plain_version():
    rng = random.Random(1)
    for slots in (2, 3, 16):
        for _ in range(20):
            weights = [rng.randint(1, 10**6) for _ in range(rng.randint(1, 60))]
            slot, total = sharding.partition(weights, slots)
            assert total == [sum(w for w, s in zip(weights, slot, strict=True) if s == k) for k in range(slots)]
            assert sorted(total) == plain_differencing(weights, slots)


def test_known_case():
    """8, 7, 6, 5, 4 in two slots: differencing leaves 2 (16 and 14), as in the literature."""
    assert sorted(sharding.partition([8, 7, 6, 5, 4], 2)[1]) == [14, 16]


def test_near_the_best():
    """Never better than the best of all partitions, and on the whole far closer to it than filling the emptiest slot in turn."""
    rng, spreads = random.Random(2), []
    for _ in range(12):
        weights = sorted((rng.randint(1, 1000) for _ in range(9)), reverse=True)
        best = min(max(t) - min(t) for a in itertools.product(range(3), repeat=9) if (t := [sum(w for w, s in zip(weights, a, strict=True) if s == k) for k in range(3)]))
        total, greedy = sharding.partition(weights, 3)[1], [0, 0, 0]
        for w in weights:
            greedy[greedy.index(min(greedy))] += w
        spreads.append((best, max(total) - min(total), max(greedy) - min(greedy)))
        assert best <= spreads[-1][1]
    assert sum(s[1] for s in spreads) < 0.75 * sum(s[2] for s in spreads)


def test_start_leaves_room():
    slot, total = sharding.partition([5] * 90, 3, [300, 0, 0])
    assert 0 not in slot and total == [300, 225, 225]
    slot, total = sharding.partition([], 3, [1, 2, 3])
    assert (slot, total) == ([], [1, 2, 3])


def test_interchanged():
    moved = sharding.interchanged({0: [9, 1, 0, 7], 1: [9, 2, 0, 5], 5: [4, 4, 4, 4]}, [0, 0, 0, 50])
    assert all(sorted(m) == [0, 1, 2, 3] and m[3] == 3 for m in moved.values())
    loads = [0, 0, 0, 0]
    for task, own in {0: [9, 1, 0, 7], 1: [9, 2, 0, 5], 5: [4, 4, 4, 4]}.items():
        for s, load in enumerate(own):
            loads[moved[task][s]] += load
    assert sorted(loads[:3]) == [7, 13, 13]  # as dealt: 22, 7 and 4


def holds(rows, texts, shards=16):
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == Counter((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    by_text = defaultdict(set)
    crc = {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1): t for d, t in texts}
    for r in rows:
        by_text[crc[r.doc_id, r.text_crc32, r.size]].add(r.shard)
    return {t: s for t, s in by_text.items()}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = sharding.sharding_query(spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert all(len(s) == 1 for s in holds(rows, docs).values())
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 0.001 * sum(sums.values()) / 16
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


@pytest.mark.parametrize("heavy, groups", [(1024, 100_000), (20, 60)])
def test_many_tasks_and_a_hot_group(spark, monkeypatch, heavy, groups):
    """A third of the bytes are copies: their shard has nothing else, the others are even, over one task or many."""
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    monkeypatch.setattr(sharding, "TASK_GROUPS", groups)
    rng = random.Random(3)
    texts = [(i, "x" * rng.randint(5, 400) + str(i)) for i in range(1500)] + [(5000 + i, "copy" * 50) for i in range(770)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("group_key", F.lit(1))
    once, again = (sorted(map(tuple, sharding.shard_documents(docs).collect())) for _ in range(2))
    assert once == again
    sums = Counter()
    for _, size, _, shard, _ in once:
        sums[shard] += size
    full = max(sums, key=sums.get)
    assert sums[full] == 770 * 201
    rest = [v for s, v in sums.items() if s != full]
    assert len(rest) == 15 and max(rest) - min(rest) < 0.02 * max(rest)


def test_odd_tables(spark, odd, no_docs):
    rows = sharding.shard_documents(odd).collect()
    by_text = holds(rows, [(r[0], r[1]) for r in odd_rows()])
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_documents(no_docs).collect() == []


def test_key_is_of_the_whole_text(spark):
    one = spark.createDataFrame([("a" * 10,), ("b",)], "text string").select(F.unhex(F.sha2("text", 256))).collect()
    assert bytes(one[0][0]) == hashlib.sha256(b"a" * 10).digest()
