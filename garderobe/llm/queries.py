"""The operators' named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from garderobe.llm import alignment, attribution, bpe, fuzzy, lexical, minhash, mixing, pages, preferences, quality, sharding, token_files, toxicity
from garderobe.session import prepare


def prepared(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(prepare(spark), sf_dir)


QUERIES = {
    "op1_mcd_quality": prepared(quality.quality_query),
    "op2_style_tree_text": prepared(pages.pages_query),
    "op3_preference_pairs": prepared(preferences.preferences_query),
    "op4_systematic_mix": prepared(mixing.mix_query),
    "op5_byte_bpe": prepared(bpe.bpe_query),
    "op6_fm_toxicity": prepared(toxicity.toxicity_query),
    "op7_token_attribution": prepared(attribution.attribution_query),
    "op8_fuzzy_hash": prepared(fuzzy.fuzzy_query),
    "op9_minhash_dedup": prepared(minhash.minhash_query),
    "op10_token_files": prepared(token_files.token_files_query),
    "op11_lexical_strata": prepared(lexical.lexical_query),
    "op12_differenced_shards": prepared(sharding.sharding_query),
    "op13_token_alignment": prepared(alignment.alignment_query),
}
ORACLES = {"op3_preference_pairs": preferences.PREFERENCES_SQL, "op4_systematic_mix": mixing.MIX_SQL, "op11_lexical_strata": lexical.LEXICAL_SQL}
