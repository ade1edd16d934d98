"""Fuzzy hashes: neighbours by plain sorting, distances by the textbook."""

import random

import pytest

from garderobe.llm import fuzzy
from tests.llm.conftest import odd_rows


def by_hand(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    return [fuzzy.hashed(r[0], r[1] or "", ordered[(i + 1) % len(ordered)][1] or "") for i, r in enumerate(ordered)]


@pytest.mark.parametrize("parts", ["1", "4"])
def test_rows(spark, odd, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in fuzzy.fuzzy_hashes(odd).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=repr) == sorted(by_hand(odd_rows()), key=repr)


def test_one_row_and_none(spark, no_docs):
    assert fuzzy.fuzzy_hashes(no_docs).collect() == []
    row = fuzzy.fuzzy_hashes(spark.createDataFrame([(4, "abcdef", 1)], "doc_id long, text string, part int")).first()
    assert row.near_next == 1.0 and row.n_chars == 6 and fuzzy.edited("abcdef", "abcdef") == "abcdab"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] if x == y else 1 + min(row[-1], old[j]))
    return row[-1]


def test_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 70))) for _ in range(2))
        assert fuzzy.distance(a, b) == slow_distance(a, b)


def test_likeness_follows_the_text():
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    for n in (40, 300, 4000):
        a, b = text(n), text(n)
        half = a[: len(a) // 2] + b[len(b) // 2 :]
        shifted = "a few new words " + a
        prints = [fuzzy.fingerprint(t) for t in (a, b, half, shifted)]
        assert fuzzy.likeness(prints[0], prints[0]) == 1 and fuzzy.likeness(prints[0], prints[1]) < 0.2
        assert 0.3 < fuzzy.likeness(prints[0], prints[2]) < 0.75 and fuzzy.likeness(prints[0], prints[3]) > 0.8
    assert fuzzy.fingerprint("same") == fuzzy.fingerprint("same") and fuzzy.likeness(fuzzy.fingerprint(""), fuzzy.fingerprint("abc")) == 0
