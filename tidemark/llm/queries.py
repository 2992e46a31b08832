"""The operators' registered queries and, where SQL can express them, their checking SQL."""

from tidemark.llm import conversation_repair, decontaminate, filter_audit, host_rules, language, packing, pitman_yor, secret_scan, simhash, substring_dedup, token_files, toxicity, warc

QUERIES = {
    "op1_captures": warc.op1_captures,
    "op2_packed_pieces": packing.op2_packed_pieces,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_files": token_files.op4_token_files,
    "op5_near_duplicates": simhash.op5_near_duplicates,
    "op6_language": language.op6_language,
    "op7_contaminated": decontaminate.op7_contaminated,
    "op8_host_rules": host_rules.op8_host_rules,
    "op9_secret_spans": secret_scan.op9_secret_spans,
    "op10_pitman_yor": pitman_yor.op10_pitman_yor,
    "op11_repaired_conversations": conversation_repair.op11_repaired_conversations,
    "op12_filter_orders": filter_audit.op12_filter_orders,
    "op13_repeated_strings": substring_dedup.op13_repeated_strings,
}

SQL: dict[str, str] = {
    "op1_captures": warc.OP1_SQL,
    "op8_host_rules": host_rules.OP8_SQL,
    "op11_repaired_conversations": conversation_repair.OP11_SQL,
    "op12_filter_orders": filter_audit.OP12_SQL,
}
