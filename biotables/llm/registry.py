"""Queries of the text operators, each next to the SQL it must equal where SQL can say it."""

from __future__ import annotations

from importlib import import_module

#: module of each registered query
MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_url_filter": "url_filter",
    "op3_ngram_jaccard": "ngram_jaccard",
    "op4_chat_quotes": "chat_quotes",
    "op5_quality_mil": "quality_mil",
    "op6_topk_inner": "topk_inner",
    "op7_template_decontam": "template_decontam",
    "op8_masked_lm": "masked_lm",
    "op9_byte_bpe": "byte_bpe",
    "op10_edit_counts": "edit_counts",
    "op11_token_alignment": "token_alignment",
    "op12_adaptive_ann": "adaptive_ann",
    "op13_importance_resample": "importance_resample",
}


def queries():
    found = {name: import_module(f"biotables.llm.{module}").query for name, module in MODULES.items()}
    return found | {"pipeline": import_module("corpus_pipeline").run}


def oracles():
    found = {name: import_module(f"biotables.llm.{module}").ORACLE_SQL for name, module in MODULES.items()}
    found["pipeline"] = import_module("corpus_pipeline").ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
