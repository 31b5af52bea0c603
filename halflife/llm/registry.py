"""Queries of the training-data operators, their oracles, and the corpus pipeline."""

from __future__ import annotations

import importlib

import corpus_pipeline

# Query name -> module of this package; each has query(spark, sf_dir) and, where SQL can say it, ORACLE.
MODULES = {
    "op1_passages": "op1_passages",
    "op2_lines": "op2_lines",
    "op3_lm": "op3_lm",
    "op4_topk": "op4_topk",
    "op5_quality": "op5_quality",
    "op6_suffixes": "op6_suffixes",
    "op7_near_dups": "op7_near_dups",
    "op8_bpe": "op8_bpe",
    "op9_toxicity": "op9_toxicity",
    "op10_mixing": "op10_mixing",
    "op11_phrases": "op11_phrases",
    "op12_audit": "op12_audit",
    "op13_secrets": "op13_secrets",
}


def _module(name: str):
    return importlib.import_module(f"halflife.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE", None))}
