"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from lexmill.llm import codes, exact, forest, language, lines, mixing, neardup, pieces, quality, secrets, suffixes, toxicity, trie

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_ann": forest.op2_ann,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_minhash_neardup": neardup.op6_minhash_neardup,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_language": language.op9_language,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE = {
    "op5_mixing": mixing.ORACLE_OP5,
    "op6_minhash_neardup": neardup.ORACLE_OP6,
    "op7_line_dedup": lines.ORACLE_OP7,
    "op8_suffix_dedup": suffixes.ORACLE_OP8,
    "op10_exact_dedup": exact.ORACLE_OP10,
    "op11_prefix_trie": trie.ORACLE_OP11,
    "op12_vector_codes": codes.ORACLE_OP12,
}
