"""Functions called by name against the columns that mean the same."""

from pyspark.sql import functions as F

from garderobe.functions import named
from garderobe.functions.hem import class_from_inches
from garderobe.functions.markup import decode_entities
from garderobe.functions.money import usd_cents
from garderobe.functions.text import words


def test_names_mean_what_columns_mean(spark):
    named.register(spark)
    named.register(spark)
    rows = [(i, t, c, x) for i, (t, c, x) in enumerate([("&#65; &#x1F457; &#X41;&#65;", "GBP", 31.5), (" Two\t words ", "XXX", 57.4), ("", None, 90.0), (None, "EUR", None)])]
    spark.createDataFrame(rows, "cents long, text string, currency string, inches double").createOrReplaceTempView("named_rows")
    got = spark.sql("select us_cents(cents * 333, currency), length_class_of(inches), numeric_references(text), words_of(text) from named_rows order by cents").collect()
    want = spark.table("named_rows").orderBy("cents").select(usd_cents(F.col("cents") * 333, F.col("currency")), class_from_inches(F.col("inches")),
                                                            decode_entities(F.col("text")), words(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0][2] == "A \U0001F457 AA"
