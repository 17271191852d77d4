"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

#: name of the query -> module that has it
MODULES = {
    "op1_license_scan": "license_scan",
    "op2_exact_topk": "exact_topk",
    "op3_quality_classifier": "quality_classifier",
    "op4_lm_scoring": "lm_scoring",
    "op5_ngram_jaccard_join": "jaccard_join",
    "op6_bpe_chunks": "bpe_chunks",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_token_files": "token_files",
    "op9_source_mix": "source_mix",
    "op10_closed_syncmers": "syncmers",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    import corpus_pipeline

    return {name: _query(name) for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"pipeline": corpus_pipeline.ORACLE_SQL}
    for name, module in MODULES.items():
        found[name] = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
    return {k: v for k, v in found.items() if v}
