"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, language_id, line_dedup, lm_score, quality, sentencepiece_codec, shards, token_count, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece_codec.query,
        "op2_token_count": token_count.query,
        "op3_jaccard_join": jaccard_join.query,
        "op4_toxicity": toxicity.query,
        "op5_quality": quality.query,
        "op6_decontaminate": decontaminate.query,
        "op7_lm_score": lm_score.query,
        "op8_line_dedup": line_dedup.query,
        "op9_language_id": language_id.query,
        "op10_shards": shards.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join.ORACLE_SQL, "op5_quality": quality.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL}
