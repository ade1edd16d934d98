"""Ranked search against its SQL twin, a plain version, and every document of a stratum."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe.llm import lexical
from tests.llm.conftest import odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    counted = [(doc, Counter(plain_terms(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    assert rows(lexical.lexical_query(spark, folder)) == sorted(con.execute(lexical.LEXICAL_SQL).fetchall(), key=repr)


@pytest.mark.parametrize("k, segment, block", [(10, 4096, 1000), (2, 1, 3)])
def test_odd_tables(spark, odd, monkeypatch, k, segment, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    items = [(1, "same words here and one two"), (2, None), (3, ""), (4, "word"), (5, "É é 日本語 1f642 nothing"), (6, "line one"), (6, "line one"), (None, "text of the same id"), (8, "x" * 7 + " AB " + "ab" * 40000)]
    table = spark.createDataFrame([(*i, 3, 1.0) for i in items], "item_id long, text string, rank int, score double")
    got = rows(lexical.search(odd, table, k))
    assert got == plain_search([(r[0], r[1]) for r in odd_rows()], items, k) and len(got) > 8


def test_empty_tables(spark, odd, no_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(no_docs, items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []


def test_ties_and_strata(spark):
    """Many equal documents: the least ids win; strata of other lengths cannot take their place."""
    docs = [(i, "red dress") for i in range(300)] + [(1000 + i, "red dress " + "pad " * i) for i in range(60)] + [(2000, "red red dress"), (2001, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(lexical.search(table.repartition(7), spark.createDataFrame([(1, "RED dress, red")], "item_id long, text string")))
    assert got == plain_search(docs, [(1, "RED dress, red")], 10)


def test_strata_are_skipped(monkeypatch):
    """A stratum whose bound lies under the known score is not scored."""
    term, tf = np.array([0]), np.array([1])
    segments = [lexical.Segment(m, [m], term, tf, np.array([1]), np.array([0]), np.array([7])) for m in (10, 20, 5000)]
    visited = []
    monkeypatch.setattr(lexical.Segment, "scores", lambda self, own, f=lexical.Segment.scores: visited.append(self.docs[0]) or f(self, own))
    best = [[]]
    lexical.visit(segments[::-1], [np.array([0])], (np.array([0]), np.array([0, 1])), best, 1)
    assert visited == [10] and best[0][0][1] == 10


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 5)
    text = "Alpha beta-gamma, ÄÖ 12x " * 20
    assert [t.decode() for chunk in lexical.term_chunks(text) for t in chunk] == plain_terms(text)


def test_extra_columns(spark, odd):
    items = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    assert rows(lexical.search(odd, items)) == rows(lexical.search(odd.select("doc_id", "text").withColumn("item_id", F.lit(1)), items))
