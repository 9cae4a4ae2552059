"""Queries of this subpackage and their checking SQL."""

from sentrylane.llm import chat, exact_dedup, html_text, licences, minhash_trees, mixing, pieces, quality, run_index, secret_scan, sharding, structure, variants

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_secret_scans": secret_scan.op3_secret_scans,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_run_index_dedup": run_index.op6_run_index_dedup,
    "op7_minhash_near_dedup": minhash_trees.op7_minhash_near_dedup,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_mixing": mixing.op9_mixing,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_license_scans": licences.op11_license_scans,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_structure_repair": structure.op13_structure_repair,
}

ORACLES = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op12_spelling_variants": variants.OP12_SQL,
    "op13_structure_repair": structure.OP13_SQL,
}
