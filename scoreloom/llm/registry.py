"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, conversations, html, licenses, mixing, neardup, pii, quality, repeats, sharding, toxicity, variants

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_main_text": html.op4_main_text,
    "op5_licence_scan": licenses.op5_licence_scan,
    "op6_multiprobe_search": ann.op6_multiprobe_search,
    "op7_repeated_strings": repeats.op7_repeated_strings,
    "op8_minimax_shards": sharding.op8_minimax_shards,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_personal_data": pii.op11_personal_data,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

#: The others are tested against brute-force versions: their methods (sketches, sampling, models) have no SQL.
ORACLE_SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op7_repeated_strings": repeats.OP7_SQL,
    "op8_minimax_shards": sharding.OP8_SQL,
    "op12_spelling_variants": variants.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
