"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from hazardframe.llm import collocations, decontaminate, exactdedup, hostrules, langid, lexical, linededup, neardedup, packing, pii, quality, suffixdedup, tokencount

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_near_dedup": neardedup.op2_near_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exactdedup.op5_exact_dedup,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_quality_rules": hostrules.op12_quality_rules,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_exact_dedup": exactdedup.OP5_SQL,
    "op7_pii": pii.OP7_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op12_quality_rules": hostrules.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
