"""Hand-computed tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from garderobe.functions import audience, brands, hem, markup, scoring, sizes
from garderobe import values as V
from garderobe.functions.coerce import coerced
from garderobe.functions.extraction import measurement_values, measurements
from garderobe.functions.model_info import model_info
from garderobe.functions.text import all_matches, color_tags, first_match, lowered, needed
from garderobe.plans import lengths


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value if not isinstance(value, (str, int, float, list)) else F.lit(value))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("label, want", [
    ("XS", [0, 2]), ("m", [8, 10]), ("US 08", [8]), ("size 7", [6, 8]), ("28", []), ("3X", [24, 26]), ("XL+", [16]), ("", []), ("One Size", [])])
def test_size_labels(spark, label, want):
    assert one(spark, sizes.normalized_sizes(F.array(F.lit(label)))) == want


@pytest.mark.parametrize("ratio, band", [
    (.5, "upper_thigh"), (.421, "upper_thigh"), (.42, "above_knee"), (.32, "above_knee"), (.311, "above_knee"), (.31, "knee"), (.261, "knee"),
    (.26, "below_knee"), (.201, "below_knee"), (.2, "mid_calf"), (.121, "mid_calf"), (.12, "ankle"), (.031, "ankle"), (.03, "floor")])
def test_hem_bands(spark, ratio, band):
    assert one(spark, hem.hem_band(F.lit(ratio))) == band


def test_hem_from_waist_and_stretch(spark):
    h = one(spark, hem.hem(F.lit(30.0), F.lit(None).cast("string"), F.lit(65.0), F.lit(2.0), None, F.lit(True), F.lit(True)))
    assert h["above_floor"] == pytest.approx(round(0.62 * 66.7 - 31, 2))
    assert one(spark, hem.hem(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(65.0)))["basis"] == "none"
    assert one(spark, hem.hem(F.lit(40.0), F.lit(None).cast("string"), F.lit(65.0), None, F.lit("image_estimate")))["confidence"] == "medium"


@pytest.mark.parametrize("text, want", [
    ("Bust: 36 in, waist 28 in, length: 44\"", (36.0, 28.0, 44.0)), ("pit to pit 18 inches", (36.0, None, None)), ("chest 92 cm", (36.2, None, None)),
    ("laid flat: waist 14", (None, 28.0, None)), ("waist to hem: 30 in", (None, None, 30.0)), ("length 300 cm", (None, None, None))])
def test_measurements(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("v", measurement_values("t"))
    m = df.select(measurements(F.col("v")).alias("m")).first()["m"]
    assert (m["bust"], m["waist"], m["length"]) == want


def test_longer_color_hides_shorter(spark):
    df = spark.createDataFrame([("Hot pink and grey dress, powder  blue, red, gold",)], "t string")
    names = df.select(F.transform(color_tags("t"), lambda c: c["name"]).alias("n")).first()["n"]
    assert names == ["hot pink", "powder blue", "gray"]


@pytest.mark.parametrize("vendor, store, want", [
    ("SP26B", ("Christy", None, "multi", []), "Christy"), ("STAUD HOLIDAY SALE 2024", ("STAUD", None, "multi", []), "STAUD"),
    ("Free People", ("Lulus", None, "multi", []), "Free People"), ("LU123", ("Lulus", None, "multi", []), "Lulus"),
    ("Playback by Ghospell", ("Sister Jane", None, "single", ["Ghospell"]), "Ghospell"), ("DREAM Voyage", ("Sister Jane", None, "single", ["Ghospell"]), "Sister Jane"),
    ("pup3", ("Petal", "Petal & Pup", "multi", []), "Petal & Pup")])
def test_brands(spark, vendor, store, want):
    df = spark.createDataFrame([(vendor, *store)], "v string, d string, n string, m string, k array<string>")
    assert df.select(brands.resolved_brand(*[F.col(c) for c in "vdnmk"]).alias("b")).first()["b"] == want


@pytest.mark.parametrize("text, labels, child", [
    ("Girls floral dress", [], True), ("Girl's night dress", [], False), ("Star child print", [], False), ("Baby blue midi", [], False), ("Baby dress", [], True),
    ("Dress", ["2T", "3T", "M"], True), ("Dress", ["4/5", "S", "M"], False), ("Dress", ["10Y", "12 yrs"], True)])
def test_audience(spark, text, labels, child):
    labels_ = F.lit(labels) if labels else F.array().cast("array<string>")
    assert (one(spark, audience.child_reason(F.lit(text), labels_)) is not None) is child


def test_text_of_markup(spark):
    html = "<p>A&nbsp;&amp; B</p><script>x</script><br/>C <b>d</b>"
    assert one(spark, markup.strip_html(F.lit(html))) == "A & B\nC d"
    assert one(spark, markup.decode_entities(F.lit("&#x41;&#66; &lt;&amp;lt;"))) == "AB <&lt;"
    assert one(spark, markup.canonical_url(F.lit("https://a.example/x?utm_source=1&id=2&ref=3#top"))) == "https://a.example/x?id=2"


def test_scores(spark):
    assert one(spark, scoring.rank_score(F.lit(0), F.lit(1))) == 1.0
    assert one(spark, scoring.relevance(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))) == pytest.approx(0.5 / 0.7)
    assert one(spark, scoring.relevance(*[F.lit(None).cast("double")] * 3)) is None
    assert one(spark, scoring.hex_distance(F.lit("#ff0000"), F.lit("00ff00"))) == pytest.approx(360.62, abs=.01)
    assert one(spark, scoring.freshness_decay(F.lit(7.0), F.lit(7.0))) == pytest.approx(.5)


@pytest.mark.parametrize("text, height, size", [
    ("Model is 5'9\" and wears a size S", 69.0, "S"), ("Length: 5'9\"", None, None), ("She is 178 cm tall, wearing size US 4", 70.1, "US 4"),
    ("model wears extra small", None, "XS"), ("our mannequin, 5 ft 8 in tall", 68.0, None),
    ("Model wears size S. Length: 175 cm", None, "S"), ("6'1\" sleeves and a lining of silk, the 5’10” model", 70.0, None), ("5'2\" or 5'3\" tall", 62.0, None), ("x" * 60 + "170 cm", None, None), ("she's 1,78 m, height 178,5cm in a M", 70.3, "M"), ("wears a size giant, she is in a medium", None, "M"), (None, None, None)])
def test_model_info(spark, text, height, size):
    got = one(spark, model_info(F.lit(text).cast("string")))
    assert (got["height"], got["size_worn"]) == (height, size)


def test_estimate_clamp(spark):
    assert one(spark, lengths.clamp_estimate(F.lit(44.04), F.lit("midi")))["inches"] == 44.0
    assert one(spark, lengths.clamp_estimate(F.lit(50.0), F.lit("midi")))["clamped"] is True
    assert one(spark, lengths.clamp_estimate(F.lit(75.0), F.lit(None).cast("string")))["clamped"] is True


def test_model_info_scans_a_text_once_for_heights(spark):
    """Places of heights are found by two passes over a text made once; their parts are read from short texts."""
    from garderobe.functions.model_info import STATED
    rows = spark.createDataFrame([("7 " * 3000 + "The model is 5\u20198\u201d tall. Length: 5'2\". She is 6'1\" tall",)], "t string")
    plan = rows.select(model_info(F.col("t")).alias("m")).select("m.*")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count(STATED) <= 2
    assert plan.first().height == 68.0


WORDED = ["Mid-Calf tea length WRAP dress", "FLOOR-length gown, gr\u00e9en", "micro\u212anit \u0130vory", "3/4 Sleeve off  shoulder fit&flare", "Black-Tie Evening", "", None,
          "waist to hem: 30 in, CHEST 92 CM, Hips 40 in flat", "laid FLAT: waist 14, length 44"]


def test_rules_by_their_words_give_what_the_rules_give(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(WORDED)], "i int, t string").withColumn("low", lowered(F.col("t")))
    tables = [V.LENGTH_WORDS, V.SILHOUETTE_WORDS, V.NECKLINE_WORDS, V.SLEEVE_WORDS, V.PATTERN_WORDS, V.FABRIC_WORDS, V.OCCASION_WORDS]
    rows = df.select(*[F.struct(read("t", table).alias("plain"), read("t", table, "low").alias("worded")) for table in tables for read in (first_match, all_matches)],
                     F.struct(measurement_values("t").alias("plain"), measurement_values("t", "low").alias("worded"))).collect()
    assert all(c["plain"] == c["worded"] for r in rows for c in r)
    assert any(c["worded"] for r in rows for c in r)


@pytest.mark.parametrize("pattern, words", [
    (r"\b(mid[-\s]?calf|tea[-\s]?length)\b", {"calf", "length"}), (r"\bhips?\s*:", {"hip"}), (r"a?b*", set()), (r"(?:x|)y", {"y"}), (r"(?:red|\d)", set())])
def test_words_that_a_match_holds(pattern, words):
    assert set(needed(pattern)) == words


def test_payload_is_parsed_once(spark):
    """The text is parsed in one place of the plan, not once for each mention of a field."""
    df = spark.createDataFrame([('{"lengthClass":" MINI ","silhouette":["wrap"],"confidence":0.25}',), ("[1]",), ("no json",), (None,)], "t string")
    rows = df.select(coerced(F.col("t")).alias("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 1
    first, *rest = [r["c"] for r in rows.collect()]
    assert (first["length_class"], first["silhouette"], first["sleeve"], first["confidence"]) == ("mini", "other", None, 0.25) and rest == [None] * 3
