"""Nearest neighbours within limits, over several blocks, against brute force."""

import random

import numpy as np

from garderobe.operators.neighbours import dense_top_k


def test_limits_by_brute_force(spark):
    rng = random.Random(7)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    catalog = [(i, vector(), rng.sample([2, 4, 6, 8], rng.randint(0, 3)), rng.choice([None, 900.0, 2500.0, 2500.0, 90000.0])) for i in range(260)]
    queries = [(i, vector(), rng.choice([[], [2], [4, 6], [8, 99], [99]]), rng.choice([None, 1000.0, 2500.0, 10.0])) for i in range(50)]
    c = spark.createDataFrame(catalog, "id int, vector array<double>, have array<int>, price double")
    q = spark.createDataFrame(queries, "qid int, vector array<double>, want array<int>, most double")
    got = {(r.qid, r.id, r["rank"]) for r in dense_top_k(q, c, 5, block_rows=16, limits=True).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = set()
    for qid, v, labels, most in queries:
        fit = [(-round(float(unit(v) @ unit(w)), 9), i) for i, w, have, price in catalog if (not labels or set(labels) & set(have)) and (most is None or price is not None and price <= most)]
        want |= {(qid, i, r) for r, (_, i) in enumerate(sorted(fit)[:5], 1)}
    assert got == want and {x[0] for x in want} < set(range(50))
