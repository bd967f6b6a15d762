"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from plumbline.llm import decontam, exact_dedup, jaccard, language, licenses, mixing, quality, search, secrets, sharding, spelling, toxicity, warc

QUERIES = {
    "op1_decontam": (decontam.op1_decontam, decontam.SQL),
    "op2_secrets": (secrets.op2_secrets, None),
    "op3_quality": (quality.op3_quality, None),
    "op4_jaccard": (jaccard.op4_jaccard, jaccard.SQL),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_exact_dedup": (exact_dedup.op6_exact_dedup, exact_dedup.SQL),
    "op7_mixing": (mixing.op7_mixing, mixing.SQL),
    "op8_licenses": (licenses.op8_licenses, None),
    "op9_sharding": (sharding.op9_sharding, sharding.SQL),
    "op10_language": (language.op10_language, None),
    "op11_warc": (warc.op11_warc, warc.SQL),
    "op12_spelling": (spelling.op12_spelling, spelling.SQL),
    "op13_search": (search.op13_search, search.SQL),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
