"""The queries of these operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import ann, decontaminate, infill, langid, mixing, pii, repair, sharding, simhash, templates, toolcalls, toxicity, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_pii": pii.query,
    "op3_nearest_neighbours": ann.query,
    "op4_compaction": sharding.query,
    "op5_decontamination": decontaminate.query,
    "op6_tool_calls": toolcalls.query,
    "op7_toxicity": toxicity.query,
    "op8_mixing": mixing.query,
    "op9_warc": warc.query,
    "op10_simhash": simhash.query,
    "op11_fill_in_middle": infill.query,
    "op12_conversation_repair": repair.query,
    "op13_main_text": templates.query,
}
ORACLES = {
    "op5_decontamination": decontaminate.SQL,
    "op6_tool_calls": toolcalls.SQL,
    "op9_warc": warc.SQL,
    "op11_fill_in_middle": infill.SQL,
}
