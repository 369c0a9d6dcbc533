"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from variorum.llm import bpe, exact_dedup, language, language_model, mixing, neighbours, quality, simhash, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language_model": language_model.op4_language_model,
        "op5_bpe": bpe.op5_bpe,
        "op6_token_file": token_file.op6_token_file,
        "op7_language": language.op7_language,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_simhash": simhash.op9_simhash,
        "pipeline": corpus_pipeline.run,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.ORACLE}
