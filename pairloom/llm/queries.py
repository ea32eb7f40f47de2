"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, language, lm, neighbours, packing, quality, token_files, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        quality.op1_quality_rules,
        decontaminate.op2_decontaminate,
        neighbours.op3_nn_descent,
        packing.op4_pack_sequences,
        lm.op5_maxent_lm,
        jaccard.op6_jaccard_join,
        toxicity.op7_toxicity,
        url_filter.op8_url_reputation,
        language.op9_language,
        token_files.op10_token_files,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.oracle(), "op6_jaccard_join": jaccard.oracle(), "op8_url_reputation": url_filter.oracle()}
