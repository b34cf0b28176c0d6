"""Queries of this package and the SQL they are checked against."""

from __future__ import annotations

from paperweave.llm import (
    anchor_simhash,
    chat_windows,
    cross_parse,
    deleted_lm,
    line_spread,
    merkle_manifest,
    pivot_index,
    spelling_variants,
    string_tiling,
    swap_packing,
    token_files,
    url_rules,
    warc_index,
)

QUERIES = {
    "op1_string_tiling": string_tiling.query,
    "op2_chat_windows": chat_windows.query,
    "op3_url_rules": url_rules.query,
    "op4_swap_packing": swap_packing.query,
    "op5_pivot_index": pivot_index.query,
    "op6_warc_index": warc_index.query,
    "op7_anchor_simhash": anchor_simhash.query,
    "op8_deleted_lm": deleted_lm.query,
    "op9_cross_parse": cross_parse.query,
    "op10_line_spread": line_spread.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_token_files": token_files.query,
}
ORACLE = {
    "op3_url_rules": url_rules.SQL,
    "op6_warc_index": warc_index.SQL,
    "op10_line_spread": line_spread.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
    "op12_merkle_manifest": merkle_manifest.SQL,
}
