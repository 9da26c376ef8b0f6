"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from inkstrata.llm import decontaminate, html_extract, importance, lbl, pieces, quality_rules, simhash, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": html_extract.query,
        "op2_warc": warc.query,
        "op3_decontaminate": decontaminate.query,
        "op4_simhash": simhash.query,
        "op5_lbl": lbl.query,
        "op6_pieces": pieces.query,
        "op7_quality_classifier": importance.query,
        "op8_quality_rules": quality_rules.query,
        "op9_token_files": token_files.query,
        "op10_toxicity": toxicity.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.SQL,
        "op3_decontaminate": decontaminate.SQL,
    }
