"""Preference pairs as one prompt and two completions with a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.ranks import ranked
from garderobe.session import stage

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"  # the role whose turns are learned


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def train_from(role: Column, text: Column, in_prompt: Column) -> Column:
    """Where in a rendered turn learning begins: after the heading of a trained turn outside the prompt, else at its end."""
    heading = F.length(F.lit(OPEN)) + F.length(F.coalesce(role, F.lit(""))) + F.length(F.lit(MIDDLE))
    return F.when(~in_prompt & role.eqNullSafe(TRAINED), heading).otherwise(F.length(rendered(role, text))).cast("long")


def positioned(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text: turns in order of ``turn``, equal rows once, rows without a conversation left out."""
    known = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null").distinct()
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    return ranked(known, ["conv_id"], order, "position").select("conv_id", "position", "role", "text")


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, position, role, text) of both sides -> pair_id, part, position, role, rendered, train_from.

    The longest common prefix of turns, by role and text, is rendered once as ``prompt`` and not learned; what follows is ``chosen`` or
    ``rejected``. Positions count from 1 without gaps on either side. Each turn is a row, so that no conversation, however long,
    has to fit into one. Equal conversations are all prompt; one that the other continues has no completion; a pair with one side only has
    no prompt. Null roles and texts equal each other and are rendered empty.
    """
    mine, other = chosen.select("pair_id", "position", "role", "text"), rejected.select("pair_id", "position", F.col("role").alias("_role"), F.col("text").alias("_text"), F.lit(True).alias("_there"))
    both = mine.withColumn("_here", F.lit(True)).join(other, ["pair_id", "position"], "full")
    same = F.col("_here").isNotNull() & F.col("_there").isNotNull() & F.col("role").eqNullSafe(F.col("_role")) & F.col("text").eqNullSafe(F.col("_text"))
    ends = stage(both.filter(~same).groupBy(F.col("pair_id").alias("_pair")).agg(F.min("position").alias("_differs")), "prefix-ends")
    sides = mine.withColumn("part", F.lit("chosen")).unionByName(rejected.select("pair_id", "position", "role", "text").withColumn("part", F.lit("rejected")))
    cut = sides.join(ends, F.col("pair_id") == F.col("_pair"), "left").withColumn("_prompt", F.coalesce(F.col("position") < F.col("_differs"), F.lit(True)))
    kept = cut.filter((F.col("part") == "chosen") | ~F.col("_prompt")).withColumn("part", F.when(F.col("_prompt"), "prompt").otherwise(F.col("part")))
    return kept.select("pair_id", "part", "position", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), train_from(F.col("role"), F.col("text"), F.col("_prompt")).alias("train_from"))


def preferences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen; as rejected the same with its last turn taken from the next conversation by id (after the last: the first)."""
    turns = stage(positioned(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    sizes = stage(ranked(turns.groupBy("conv_id").agg(F.max("position").alias("n")), [], [F.col("conv_id").asc()], "place"), "conversations")
    total = sizes.count()
    last = turns.join(sizes, "conv_id").filter("position = n").select("conv_id", "place", "n", "role", "text")
    before = F.when(F.col("place") == 1, F.lit(total)).otherwise(F.col("place") - 1)
    given = last.select(before.alias("place"), "role", "text").join(sizes.select("place", F.col("conv_id").alias("pair_id"), F.col("n").alias("position")), "place").select("pair_id", "position", "role", "text")
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    kept = chosen.join(sizes.select(F.col("conv_id").alias("pair_id"), "n"), "pair_id").filter("position < n").select("pair_id", "position", "role", "text")
    return preference_segments(chosen, kept.unionByName(given))


PREFERENCES_SQL = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position, role, text
               FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, max(position) AS n FROM turns GROUP BY conv_id),
chain AS (SELECT conv_id, n, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first_value(conv_id) OVER (ORDER BY conv_id)) AS giver FROM sizes),
rejected AS (SELECT t.conv_id, t.position, t.role, t.text FROM turns t JOIN chain c ON t.conv_id = c.conv_id AND t.position < c.n
  UNION ALL SELECT c.conv_id, c.n, t.role, t.text FROM chain c JOIN sizes s ON s.conv_id = c.giver JOIN turns t ON t.conv_id = c.giver AND t.position = s.n),
ends AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.position, b.position)) AS differs FROM turns a FULL JOIN rejected b ON a.conv_id = b.conv_id AND a.position = b.position
  WHERE a.conv_id IS NULL OR b.conv_id IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
sides AS (SELECT 'chosen' AS side, * FROM turns UNION ALL SELECT 'rejected', * FROM rejected),
cut AS (SELECT s.*, coalesce(s.position < e.differs, true) AS prompt FROM sides s LEFT JOIN ends e ON s.conv_id = e.conv_id),
shown AS (SELECT *, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM cut WHERE side = 'chosen' OR NOT prompt)
SELECT conv_id AS pair_id, CASE WHEN prompt THEN 'prompt' ELSE side END AS part, position, role, rendered,
  CAST(CASE WHEN NOT prompt AND role = '{TRAINED}' THEN length(role) + {len(OPEN) + len(MIDDLE)} ELSE length(rendered) END AS BIGINT) AS train_from FROM shown
"""
