"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import (
    decontaminate,
    fingerprints,
    html_text,
    importance,
    line_dedup,
    mixing,
    near_dup,
    pii,
    quality,
    runs,
    suffix_dedup,
    toxicity,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_pii": pii.op2_pii,
        "op3_quality": quality.op3_quality,
        "op4_lines": line_dedup.op4_lines,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_warc": warc.op7_warc,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_mix": mixing.op9_mix,
        "op10_near_dup": near_dup.op10_near_dup,
        "op11_html_text": html_text.op11_html_text,
        "op12_importance": importance.op12_importance,
        "op13_runs": runs.op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.OP1_SQL,
        "op4_lines": line_dedup.OP4_SQL,
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op7_warc": warc.OP7_SQL,
        "op9_mix": mixing.OP9_SQL,
        "op10_near_dup": near_dup.OP10_SQL,
        "op12_importance": importance.OP12_SQL,
    }
