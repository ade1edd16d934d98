"""Signals of a search string in order, terms taken back, and the merge of a second parse, on small hand-made cases."""

import pytest

from garderobe.functions.interpret import interpret, merge_parse

BRANDS = ["Ann Taylor", "Ann Taylor Loft", "Rust & Co"]
OTHER = ("query_id int, price_min_cents long, price_max_cents long, sizes array<int>, length_classes array<string>, brands array<string>, occasions array<string>, "
         "colors array<string>, fabrics array<string>, silhouettes array<string>, vibe_text string")


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame([(b,) for b in BRANDS], "brand string")


def read(spark, brands, *texts):
    rows = [(i, *(t if isinstance(t, tuple) else (t, []))) for i, t in enumerate(texts)]
    return interpret(spark.createDataFrame(rows, "query_id int, text string, lexical_terms array<string>"), brands)


def told(row):
    return [(s.kind, s.term, s.value, s.hard) for s in row.signals]


def test_signals_in_order(spark, brands):
    parsed = read(spark, brands, "Red ann  taylor Gown size 8 sz 30 under $50 or under $70.50, red silk boho", ("navy wrap dress", ["Navy"]), "", None)
    rows = {r.query_id: r for r in parsed.collect()}
    assert told(rows[0]) == [
        ("price", "under $50", "under $50", True), ("price", "under $70.50", "under $71", True), ("size", "size 8", "size 8", True),
        ("brand", "ann taylor", "Ann Taylor", True), ("length", "Gown", "maxi", True), ("length", "Gown", "floor", True), ("occasion", "Gown", "formal", False),
        ("pattern", "boho", "floral", False), ("silhouette", "boho", "tent", False), ("fabric", "silk", "silk", False), ("color", "Red", "red", False)]
    assert rows[0].price_max_cents == 5000 and set(rows[0].brands) == {"Ann Taylor", "Ann Taylor Loft"}
    assert told(rows[1]) == [("silhouette", "wrap", "wrap", False)] and rows[1].residual == ["navy"] and rows[1].lexical_terms == ["Navy"]
    assert not rows[2].signals


def test_what_was_taken_back_stays_away(spark, brands):
    gone = ["$10–$21", "size 4", "6", "mini", "rust & co", "green", "Silk Charmeuse", "dreamy"]
    other = [(0, 1000, 2050, [4, 6, 8, 40], ["mini", "midi"], ["Rust & Co", "ann taylor", "nobody"], ["party"], ["Green", "RED"], ["Silk charmeuse", "linen blend"], ["tent"], "a dreamy  mood")]
    stage1 = read(spark, brands, ("party", gone), ("party", None), ("party", []))
    both = merge_parse(stage1, spark.createDataFrame(other + [(1, *other[0][1:])], OTHER), brands)
    rows = {r.query_id: r for r in both.collect()}
    r = rows[0]
    assert (r.price_min_cents, r.price_max_cents, r.sizes, r.length_classes) == (None, None, [8], ["midi"])
    assert (r.brands, r.colors, r.fabrics, r.vibe_text) == (["Ann Taylor", "Ann Taylor Loft"], ["red"], ["linen"], "a mood")
    assert [s[:3] for s in told(r)] == [("occasion", "party", "party"), ("size", "size 8", "size 8"), ("length", "midi", "midi"), ("brand", "ann taylor", "Ann Taylor"),
                                        ("color", "red", "red"), ("fabric", "linen", "linen"), ("silhouette", "tent", "tent")]
    assert (rows[1].price_min_cents, rows[1].sizes, rows[1].colors) == (1000, [4, 6, 8], ["green", "red"]) and ("price", "$10–$21", "$10–$21", True) in told(rows[1])
    assert told(rows[2]) == [("occasion", "party", "party", False)] and rows[2].vibe_text is None
