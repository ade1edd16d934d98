"""Operators against brute force on small random frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from garderobe.plans import deck
from garderobe.operators import cells, folds, neighbours, quantiles
from garderobe.operators.diversity import greedy_order, interleave, spread_report
from garderobe.operators.ranking import stratified_cap


def rows_of_catalog(n, seed, hot=0.5):
    """Random listings in which one source and one brand hold about half of all rows."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = "s0" if rnd.random() < hot else f"s{rnd.randrange(1, 5)}"
        brand = "hot" if rnd.random() < hot else rnd.choice([None, " B1", "b1", "B2", "B3"])
        out.append((f"p{i:04d}", source, brand, rnd.randrange(50), rnd.choice([[], [8], [8, 10], [4]]), rnd.randrange(100, 5000)))
    return out


SCHEMA = "listing_id string, source_id string, brand string, last_seen_ms long, size_normalized array<int>, usd_cents long"


def fair_cap(rows, cap):
    """Round-robin over sources, inside a source over brands, newest first everywhere."""
    newest = lambda r: (-r[3], r[0])

    def turns(queues):
        out, depth = [], 0
        while any(depth < len(q) for q in queues):
            out += sorted((q[depth] for q in queues if depth < len(q)), key=newest)
            depth += 1
        return out

    shops = {}
    for r in sorted(rows, key=newest):
        shops.setdefault(r[1], {}).setdefault((r[2] or "").strip().lower(), []).append(r)
    return {r[0] for r in turns([turns(list(b.values())) for b in shops.values()])[:cap]}


@pytest.mark.parametrize("cap", [1, 7, 40, 150, 400])
def test_stratified_cap(spark, cap):
    rows = rows_of_catalog(300, cap)
    got = {r[0] for r in stratified_cap(spark.createDataFrame(rows, SCHEMA), cap=cap).select("listing_id").collect()}
    assert got == fair_cap(rows, cap)


@pytest.mark.parametrize("cap", [5, 60])
def test_profile_pools(spark, cap):
    rows = rows_of_catalog(400, 7 + cap)
    profiles = [("a", [8], 150, 3777), ("b", [], None, None), ("c", [4, 10], 0, 999), ("d", [8, 4], 1024, None), ("e", [26], 4999, 4999), ("f", [8], 500, 400)]
    df = spark.createDataFrame(profiles, "profile_id string, sizes array<int>, low long, high long")
    got = {}
    for r in cells.profile_candidates(df, spark.createDataFrame(rows, SCHEMA), cap).collect():
        got.setdefault(r["profile_id"], set()).add(r["listing_id"])
    for name, sizes, low, high in profiles:
        fits = [r for r in rows if (not sizes or not r[4] or set(sizes) & set(r[4])) and (low is None or r[5] >= low) and (high is None or r[5] <= high)]
        assert got.get(name, set()) == fair_cap(fits, cap), name


def strictness(placed, brand, source, brands, sources):
    """Which bounds a card would keep after those placed: 0 all, 1 not that of its source, 2 not that of its brand, 3 not even the run."""
    last, window = [brands[i] for i in placed[-2:]], placed[-23:]
    long_run = last == [brand, brand]
    crowded_brand = [brands[i] for i in window].count(brand) >= 6
    crowded_source = [sources[i] for i in window].count(source) >= 12
    return 3 if long_run else 2 if crowded_brand else 1 if crowded_source else 0


@pytest.mark.parametrize("seed", range(6))
def test_greedy_order(seed):
    rnd = random.Random(seed)
    n = rnd.choice([1, 2, 60, 150])
    brands = np.array([rnd.choice("aaaaaabcde") for _ in range(n)])
    sources = np.array([rnd.choice("xxxyz") for _ in range(n)])
    order = [int(i) for i in greedy_order(brands, sources)]
    assert sorted(order) == list(range(n))
    for k, card in enumerate(order):  # each card is the first of those that break the least
        broken = {i: strictness(order[:k], brands[i], sources[i], brands, sources) for i in order[k:]}
        assert card == min(i for i in broken if broken[i] == min(broken.values()))


def test_interleave_keeps_rows_and_bounds(spark):
    rows = [(u, f"p{i}", i, f"b{i % 9 if i > 8 else 0}", f"s{i % 3}") for u in (1, 2) for i in range(90)]
    df = spark.createDataFrame(rows, "user_id long, listing_id string, rank int, spread string, source_id string")
    placed = interleave(df, "user_id")
    assert placed.count() == len(rows) and placed.select("user_id", "position").distinct().count() == len(rows)
    report = spread_report(placed, "user_id").collect()
    assert all(r["longest_run"] <= 2 and r["n"] == 90 for r in report)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_neighbours(spark, block_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 6))
    base[:50] = base[0] + rng.normal(size=(50, 6)) * 0.01  # a third and more of the rows near one pivot
    base[60] = base[61]
    catalog = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v], i % 5) for i, v in enumerate(base)], "id string, vector array<double>, tie long")
    queries = catalog.select(F.col("id").alias("qid"), "vector")
    got = {}
    for r in neighbours.dense_top_k(queries, catalog, 4, drop_self=True, block_rows=block_rows).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    for i in range(len(base)):
        order = sorted((j for j in range(len(base)) if j != i), key=lambda j: (-cos[i, j], -(j % 5), f"v{j:03d}"))[:4]
        assert [got[f"v{i:03d}"][k] for k in (1, 2, 3, 4)] == [f"v{j:03d}" for j in order]


def test_clamped_fold_with_a_hot_key(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < .6 else f"k{rnd.randrange(5)}", i, rnd.uniform(-.6, .6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n long, d double").repartition(6)
    start = spark.createDataFrame([("hot", .9), ("idle", .25)], "k string, value double")
    got = {r["k"]: r["value"] for r in folds.clamped_fold(df, ["k"], ["n"], "d", -1.0, 1.0, start).collect()}
    want = {"hot": .9, "idle": .25}
    for k, _, d in rows:
        want[k] = max(-1.0, min(1.0, want.get(k, 0.0) + d))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("values, want", [([60_000, 90_000], 75_000), ([3, 1, 2], 2), ([1, 2], 2), ([5] * 9, 5), (list(range(10_001)), 5000)])
def test_exact_median(spark, values, want):
    df = spark.createDataFrame([("w", v) for v in values] + [("w", None)], "w string, v long")
    assert quantiles.exact_median(df, ["w"], "v").collect() == [("w", want)]


def test_accepted_hits_like_a_loop(spark, sf):
    from workload.registry import QUERIES
    import workload  # noqa: F401

    rows = sorted(QUERIES["stream_accepted_hits"](spark, sf).collect(), key=lambda r: (r["at_ms"], r["hit_id"]))
    kept = {}
    for r in rows:
        inside = [t for t in kept.get(r["key"], []) if t > r["at_ms"] - 6 * 3_600_000]
        assert r["accepted"] is (len(inside) < 2)
        kept[r["key"]] = inside + [r["at_ms"]] * (len(inside) < 2)
    assert len(rows) == 1000


def test_stream_cut_into_files_learns_the_same(spark, sf, tmp_path):
    from garderobe.plans.taste import style_tags
    from garderobe.sources import tables as T
    from garderobe.streaming import jobs
    from garderobe.streaming.runtime import file_stream

    events = T.read(spark, sf, "events").orderBy("ts").limit(400).toPandas()
    for i in range(4):
        spark.createDataFrame(events.iloc[i * 100:(i + 1) * 100]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    catalog = T.candidates(spark, sf)
    streamed = jobs.style_vectors(T.swipes(spark, sf, file_stream(spark, f"{tmp_path}/in", "*.parquet", 1)), catalog)
    whole = style_tags(T.swipes(spark, sf, spark.read.parquet(f"{tmp_path}/in")), catalog)
    rounded = lambda df: {(r["user_id"], r["tag"], round(r["value"], 6)) for r in df.collect()}
    assert rounded(streamed) == rounded(whole)


@pytest.mark.parametrize("seed", range(3))
def test_calibration_deck(spark, seed):
    """Every card stands where its brand has its turn, and no card left of the brand would have shown more."""
    rnd = random.Random(seed)
    pool = [(u, f"p{i}", i, rnd.choice("xyz"), rnd.choice("abcd")) for u in (1, 2) for i in range(40)]
    looks = {f"p{i}": (rnd.choice(["wrap", "slip", "sheath", None]), rnd.choice(["red", "navy", None]), rnd.choice(["midi", None])) for i in range(40)}
    ranked = spark.createDataFrame(pool, "user_id long, listing_id string, rank int, source_id string, spread string")
    catalog = spark.createDataFrame([(k, s, [{"family": c}] if c else [], n) for k, (s, c, n) in looks.items()], "listing_id string, silhouette string, colors array<struct<family: string>>, length_class string")
    excluded = spark.createDataFrame([(1, "silhouette", "wrap"), (1, "color", "red")], "user_id long, kind string, value string")
    shown = spark.createDataFrame([(1, "p0"), (1, "p1"), (2, "p5")], "user_id long, listing_id string")
    got = {}
    for r in deck.calibration_deck(ranked, catalog, excluded, shown, n=30).orderBy("user_id", "card").collect():
        got.setdefault(r.user_id, []).append(r.listing_id)
    seen = {1: ["p0", "p1"], 2: ["p5"]}
    for user, cards in got.items():
        items = {p: (rank, s, b) for u, p, rank, s, b in pool if u == user}
        soft = {p for p in items if user == 1 and (looks[p][0] == "wrap" or looks[p][1] == "red")}
        shapes, combos = {looks[p][0] or "unknown" for p in seen[user]}, {looks[p] for p in seen[user]}
        left = [p for p in items if p not in seen[user]]
        assert len(cards) == min(30, len(left)) == len(set(cards)) and not set(cards) & set(seen[user])
        strict = [p for p in cards if p not in soft]
        assert cards[: len(strict)] == strict and (len(strict) == len([p for p in left if p not in soft]) or len(strict) == 30)
        for part in (strict, cards[len(strict):]):
            pool_of = [p for p in left if (p in soft) == (part is not strict)]
            taken = {}
            for p in part:
                _, s, b = items[p]
                brand = [q for q in pool_of if items[q][1:] == (s, b)]
                free = [q for q in brand if q not in cards[: cards.index(p)]]
                news = [q for q in free if (looks[q][0] or "unknown") not in shapes] or [q for q in free if looks[q] not in combos] or free
                assert p == min(news, key=lambda q: items[q][0])
                shapes.add(looks[p][0] or "unknown")
                combos.add(looks[p])
                taken[s, b] = taken.get((s, b), 0) + 1
                others = [c for c in {items[q][2] for q in pool_of if items[q][1] == s} if len([q for q in pool_of if items[q][1:] == (s, c)]) > taken.get((s, c), 0)]
                assert all(taken.get((s, c), 0) >= taken[s, b] - 1 for c in others)  # no brand of the source waits while another has two turns


def test_a_vector_is_sent_once_to_a_lot(spark, monkeypatch):
    """Vectors are multiplied by lots and chunks, not by blocks, and a query id on two rows has both ranked together."""
    rng = np.random.default_rng(4)
    rows = [(f"v{i}", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    catalog = spark.createDataFrame(rows, "id string, vector array<double>")
    queries = spark.createDataFrame([*rows[:40], rows[0], (None, rows[1][1])], "qid string, vector array<double>")
    sent, search = [], neighbours._search

    def counted(asked, held, *rest):
        sent.append((asked.count(), held.count(), held.select("cell", "sub").distinct().count()))
        return search(asked, held, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    got = neighbours.dense_top_k(queries, catalog, 3, block_rows=16).collect()
    near, all_ = sent
    assert near[:2] == (41, 300) or near[0] == 41 and near[1] < 300
    blocks, lots, chunks = all_[2], -(-300 // 64), -(-41 // 16)
    assert blocks > 2 * lots and all_[0] <= 41 * lots and all_[1] == 300 * chunks
    assert len(got) == 40 * 3 and [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == "v0"][:2] == ["v0", "v0"]


def test_deck_leaves_pairs_in_place(spark):
    """Pairs that come by user are not shuffled by listing, nor made twice."""
    ranked = spark.createDataFrame([(u, f"p{i}", i, "x", "a") for u in range(4) for i in range(6)], "user_id long, listing_id string, rank int, source_id string, spread string").repartition(3, "user_id")
    catalog = spark.createDataFrame([(f"p{i}", "wrap", [{"family": "red"}], "midi") for i in range(6)], "listing_id string, silhouette string, colors array<struct<family: string>>, length_class string")
    excluded = spark.createDataFrame([(1, "color", "red")], "user_id long, kind string, value string")
    shown = spark.createDataFrame([(1, "p0")], "user_id long, listing_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        deal = deck.calibration_deck(ranked, catalog, excluded, shown)
        plan = deal._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and "hashpartitioning(user_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(" in x and "user_id" in x.split("hashpartitioning(")[1].split("),")[0] and "listing_id" in x.split("hashpartitioning(")[1].split("),")[0]]
        assert deal.filter("user_id = 1 and listing_id = 'p0'").count() == 0 and deal.count() == 23
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
