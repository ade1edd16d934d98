"""The machine learns pairs, is accurate on held-out texts, and reads labels of the right rows only."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from garderobe.llm import toxicity
from tests.llm.conftest import odd_rows


def test_pairs_that_no_sum_of_weights_tells():
    """Toxic: insult with group, or neither; one alone is not. No single term separates the classes."""
    rng = np.random.default_rng(1)
    terms = np.arange(50, dtype=np.uint32)
    texts, labels = [], []
    for _ in range(1500):
        insult, group = rng.integers(0, 2, 2)
        rest = rng.choice(np.arange(2, 50), 10, replace=False)
        texts.append(np.array(sorted([*([0] if insult else []), *([1] if group else []), *rest]), np.uint32))
        labels.append(int(insult == group))
    labels = np.array(labels)
    machine, flat = toxicity.fit(texts[:1000], labels[:1000], terms=terms), toxicity.fit(texts[:1000], labels[:1000], factors=1, terms=terms)
    flat.factors[:] = 0
    right = lambda m: np.mean([(m.score(t.astype(np.int64)) >= 0.5) == y for t, y in zip(texts[1000:], labels[1000:], strict=True)])
    assert right(machine) > 0.9 and right(flat) < 0.65


def test_margin_by_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(9, dtype=np.uint32), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    own = np.array([0, 3, 4, 8])
    pairs = sum(m.factors[a] @ m.factors[b] for i, a in enumerate(own) for b in own[:i])
    assert np.isclose(m.margin(own), 0.3 + m.weights[own].sum() + pairs)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity_query(spark, folder).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    found = [r for r in held if r.predicted]
    assert sum(r.toxic for r in found) / len(found) > 0.8 and sum(r.toxic for r in found) / sum(r.toxic for r in held) > 0.6


def test_held_out_labels_teach_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    once, again = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, turned))
    assert once == again


def test_odd_tables(spark, odd, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (3, None, 0), (None, 1, 1), (6, 5, 0), (999, 1, 0), (9, 0, 1), (9, 1, 1), (15, 0, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_score_of_a_text_alone(spark, odd):
    """Runs, caches and neighbours change no score."""
    machine = toxicity.Machine(np.sort(np.array(toxicity.terms_of(b"same words here one two"), np.uint32)), -1.0, np.linspace(-1, 1, len(toxicity.terms_of(b"same words here one two"))), np.zeros((len(toxicity.terms_of(b"same words here one two")), 8)))
    alone = toxicity.Scorer(machine)
    got = {(r.doc_id, r.text): r.s for r in toxicity.with_score(odd, machine, "s").collect()}
    assert all(got[r[0], r[1]] == alone.scores([r[1] or ""])[0] for r in odd_rows())


def test_terms_of_pairs_are_chosen():
    """Toxic: both or neither of two terms, each as frequent in clean as in toxic texts. The machine has to find them among the others."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for k in range(1600):
        insult, group = k % 2, k // 2 % 2
        rest = rng.choice(np.arange(2, 700), 10, replace=False)
        texts.append(np.array(sorted([*([0] if insult else []), *([1] if group else []), *rest]), np.uint32))
        labels.append(int(insult == group))
    labels = np.array(labels)
    machine = toxicity.fit(texts[:1200], labels[:1200])
    assert {0, 1} <= set(machine.terms.tolist()) and len(machine.terms) < 50
    right = [(machine.score(np.flatnonzero(np.isin(machine.terms, t))) >= 0.5) == y for t, y in zip(texts[1200:], labels[1200:], strict=True)]
    assert np.mean(right) > 0.9
