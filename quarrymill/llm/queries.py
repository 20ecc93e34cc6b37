"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, langid, lines, neardup, packing, quality, substrings, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": tokens.op1_token_ids,
        "op2_language_id": langid.op2_language_id,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_suffix_dedup": substrings.op5_suffix_dedup,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_substring_dedup": fingerprints.op8_substring_dedup,
        "op9_minhash_near_dedup": neardup.op9_minhash_near_dedup,
        "op10_line_dedup": lines.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.ORACLE, "op10_line_dedup": lines.ORACLE}
