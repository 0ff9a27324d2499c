"""Queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from tessera.llm import bpe, langid, licences, negatives, packing, repair, simhash, sketch, suffixes, telephony, toolcalls, toxicity, urls

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1,
    "op2_language_id": langid.op2,
    "op3_tool_calls": toolcalls.op3,
    "op4_suffix_dedup": suffixes.op4,
    "op5_licence_scan": licences.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_url_filter": urls.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_telephony_audio": telephony.op9,
    "op10_bottom_k_sketch": sketch.op10,
    "op11_conversation_repair": repair.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_toxicity": toxicity.op13,
}

#: SQL of those that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op3_tool_calls": toolcalls.OP3_SQL, "op11_conversation_repair": repair.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
