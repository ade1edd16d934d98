"""Each stage of the pipeline against what its operator says of the stage's own input."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from garderobe.llm import minhash, quality, toxicity
from tests.llm.test_minhash import brute


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_stages(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    inputs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], sf).write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert inputs[-1].columns == inputs[0].columns and inputs[-1].count() > 0
    docs, good, clean, single, mixed, done = inputs
    assert ids(good) == ids(quality.judged(docs).filter("kept"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids(clean) == ids(toxicity.toxicity(good, labels).filter("predicted = 0"))
    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    assert ids(single) == sorted(d for d, _, _, kept in brute(rows, minhash.PER_CENT) if kept)
    assert set(ids(mixed)) <= set(ids(single)) and ids(done) == ids(mixed) and done.filter("size(ids) <> n_tokens").count() == 0


def test_one_of_repeated_ids(spark):
    rows = [(1, "b b b b b b b", "x"), (1, "b b b b b b b", "x"), (1, "a", "x"), (None, "n", "x"), (None, "n", "x"), (2, "b b b b b b b", "y")]
    got = [tuple(r) for r in minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a", "x"), (None, "n", "x"), (None, "n", "x")], key=repr)


def test_columns_that_clash(spark, sf):
    """Columns named like those that the operators make come back as they were."""
    names = ["kept", "group", "distance", "_text", "_words", "_toxicity", "target", "copies", "source_size", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() and not out.filter(" or ".join(f"`{name}` <> concat('{name} ', doc_id)" for name in names)).count()
