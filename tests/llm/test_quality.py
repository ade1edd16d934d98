"""Quality rules against plain Python and a plain concentration loop."""

import collections
import random
import re

import numpy as np
import pytest

from garderobe.llm import quality
from tests.llm.conftest import odd_rows


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts(odd):
    got = quality.with_statistics(odd).select("doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(r[0], *counts(r[1])) for r in odd_rows()], key=repr)


def test_overlapping_repeats(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    got = quality.with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).select("doc_id", "_quality.n_repeat_words").collect()
    assert {r[0]: r[1] for r in got} == {i: counts(t)[4] for i, t in enumerate(texts)}


def prose(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


def made():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(700):
        text = prose(rnd, rnd.randint(30, 300), words)
        rows.append((i, text, "en" if i % 4 else "de", "hot" if i % 3 else f"s{i % 40}", "good"))
    for i in range(700, 760):
        junk = " ".join(w + "###" for w in prose(rnd, 80, words).split()) if i % 2 else prose(rnd, 80, words).upper() + " !!"
        rows.append((i, junk, "en", "hot", "bad"))
    return rows


def by_hand(vectors):
    """The same estimate with numpy: start, steps and bins written out."""
    p, floors = quality.P, np.array(quality.FLOORS)

    def middle(v):
        g = np.sort(np.floor(np.abs(v) * quality.GRID + 0.5) * np.sign(v))
        return g[(len(g) + 1) // 2 - 1] / quality.GRID

    mean = np.array([middle(v) for v in vectors.T])
    cov = np.diag([(middle(np.abs(v - m)) * 1.4826) ** 2 for v, m in zip(vectors.T, mean, strict=True)])
    for step in range(quality.STEPS + 1):
        d = np.einsum("ij,jk,ik->i", vectors - mean, np.linalg.inv(cov + np.diag(floors**2)), vectors - mean)
        if step == quality.STEPS:
            return d
        bins = np.floor(np.log(d + 1e-9) * quality.BINS)
        end = np.sort(bins)[int(np.ceil(len(d) * quality.SHARE)) - 1]
        inner = vectors[bins <= end]
        mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True).reshape(p, p) * quality.CONSISTENCY


def test_outliers_by_hand(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, label string")
    rows = quality.judged(docs).select("doc_id", "label", "group", "distance", "kept", "_quality.*").collect()
    judged = collections.defaultdict(list)
    for r in rows:
        assert not r.base_failed
        judged[r.group].append(r)
    assert 'source {"lang":"en","source":"hot"}' in judged and len(judged) >= 3
    for name, group in judged.items():
        if name == "rest":
            assert len(group) < quality.LEAST_GROUP and all(r.distance is None and r.kept for r in group)
            continue
        want = by_hand(np.array([[r[f"x{i}"] for i in range(quality.P)] for r in group]))
        assert np.allclose([r.distance for r in group], want, rtol=1e-5, atol=1e-7)
    assert {r.label for r in rows if not r.kept} == {"bad"} and sum(not r.kept for r in rows) == 60


def test_odd_and_small_tables(odd, no_docs):
    got = quality.judged(odd)
    assert got.count() == len(odd_rows()) and got.filter("kept and _quality.base_failed").count() == 0
    assert got.filter("distance is not null").count() == 0 and quality.judged(no_docs).collect() == []


def test_chi_square():
    assert abs(quality.chi_square_point(0.95, 2) - 9.4877) < 1e-3 and abs(quality.chi_square_point(0.5, 1) - 1.3863) < 1e-3


def with_junk(share, exact):
    """200 texts of prose and so many junk ones that they are ``share`` of all: copies of one, or each with a word of its own."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows = [(i, prose(rnd, rnd.randint(30, 300), words), "en", "s", "good") for i in range(200)]
    junk = " ".join(w + "###" for w in prose(rnd, 80, words).split())
    return rows + [(200 + i, junk if exact else f"{junk} {rnd.choice(words)}", "en", "s", "bad") for i in range(round(200 * share / (1 - share)))]


@pytest.mark.parametrize("exact,share", [(True, 1 / 3), (False, 1 / 3), (True, 0.6)])
def test_many_copies_of_one_outlier(spark, exact, share):
    rows = quality.judged(spark.createDataFrame(with_junk(share, exact), "doc_id long, text string, lang string, source string, label string")).collect()
    assert {r.label for r in rows if not r.kept} == {"bad"} and all(not r.kept for r in rows if r.label == "bad")


def test_least_determinant(spark):
    """Of three estimates the narrowest is kept; of two that are as narrow, the first."""
    names = [f"m{i}" for i in range(quality.P)] + [f"l{i}{j}" for i, j in quality.PAIRS]
    def shape(group, start, width):
        return (group, start, *[float(start)] * quality.P, *[width if i == j else 0.0 for i, j in quality.PAIRS])
    made = [shape("a", 0, 1.0), shape("a", 1, 0.5), shape("a", 2, 0.9), shape("b", 0, 1.0), shape("b", 1, 0.999), shape("b", 2, 2.0)]
    got = quality.least_determinant(spark.createDataFrame(made, ["_group", "start", *names]))
    assert {r["_group"]: r.m0 for r in got.collect()} == {"a": 1.0, "b": 0.0}
