"""Decks of many users at once, against one user at a time."""

import random

import pyarrow as pa

from garderobe.plans import deck

CARDS = pa.list_(pa.struct([("rank", pa.int32()), *((c, pa.string()) for c in ("source_id", "spread", "shape", "combo")), ("soft", pa.bool_()), ("seen", pa.bool_())]))
NAMES = [f.name for f in CARDS.value_type]


def test_users_of_a_batch_do_not_mix():
    rnd = random.Random(3)
    users = [[(rank, rnd.choice("xy"), rnd.choice(["a", "b", None]), rnd.choice("ws"), rnd.choice("pqr"), rnd.random() < 0.3, rnd.random() < 0.2) for rank in rnd.sample(range(99), n)] for n in (30, 0, 1, 50, 12)]
    rows = [[dict(zip(NAMES, card, strict=True)) for card in own] for own in users]
    whole = deck.deal(pa.array(rows, CARDS), 12).to_pylist()
    assert whole == [deck.deal(pa.array([own], CARDS), 12).to_pylist()[0] for own in rows] and whole[2:] == deck.deal(pa.array(rows, CARDS).slice(2), 12).to_pylist()
    for own, cards in zip(users, whole, strict=True):
        fresh = [c for c, card in enumerate(own) if not card[6]]
        assert len(cards) == len(set(cards)) == min(12, len(fresh)) and set(cards) <= set(fresh)


def test_no_user_alone_in_python(spark):
    """Cards travel in batches of users, and no window is laid over the pairs."""
    ranked = spark.createDataFrame([(u, f"p{i}", i, "x", "a") for u in (1, None) for i in range(6)], "user_id long, listing_id string, rank int, source_id string, spread string")
    catalog = spark.createDataFrame([(f"p{i}", "wrap", [{"family": "red"}], "midi") for i in range(6)], "listing_id string, silhouette string, colors array<struct<family: string>>, length_class string")
    dealt = deck.calibration_deck(ranked, catalog)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Window" not in plan
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted([(u, i, f"p{i}") for u in (1, None) for i in range(6)], key=repr)
