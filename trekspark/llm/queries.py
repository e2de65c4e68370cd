"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from trekspark.llm import chat_format, embedding_dedup, license_scan, line_dedup, mixing, packing, periodic_runs, simhash_dedup, topk_search, toxicity, turn_repair, url_filter, warc

QUERIES = {
    "op1_fuzzy_line_dedup": line_dedup.op1_fuzzy_line_dedup,
    "op2_pivot_table_top_k": topk_search.op2_pivot_table_top_k,
    "op3_warc_derivatives": warc.op3_warc_derivatives,
    "op4_toxicity_noisy_or": toxicity.op4_toxicity_noisy_or,
    "op5_sainte_lague_mixing": mixing.op5_sainte_lague_mixing,
    "op6_epsilon_grid_order": embedding_dedup.op6_epsilon_grid_order,
    "op7_simhash_near_dedup": simhash_dedup.op7_simhash_near_dedup,
    "op8_signature_rules": license_scan.op8_signature_rules,
    "op9_link_graph_filter": url_filter.op9_link_graph_filter,
    "op10_minimum_bin_slack": packing.op10_minimum_bin_slack,
    "op11_prefix_doubling_repair": turn_repair.op11_prefix_doubling_repair,
    "op12_prefix_target_expansion": chat_format.op12_prefix_target_expansion,
    "op13_dyadic_square_catching": periodic_runs.op13_dyadic_square_catching,
}

ORACLE_SQL: dict[str, str] = {
    "op5_sainte_lague_mixing": mixing.OP5_SQL,
    "op2_pivot_table_top_k": topk_search.OP2_SQL,
    "op6_epsilon_grid_order": embedding_dedup.OP6_SQL,
    "op11_prefix_doubling_repair": turn_repair.op11_prefix_doubling_repair,
    "op12_prefix_target_expansion": chat_format.OP12_SQL,
}
