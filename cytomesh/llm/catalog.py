"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from cytomesh.llm import chat, langid, mixing, neardup, packing, periodic, postings, quality, scoring, sharding, tokenpairs, topk, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_language_id": langid.op4_language_id,
    "op8_quality_rules": quality.op8_quality_rules,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_lm_scoring": scoring.op7_lm_scoring,
    "op9_packing": packing.op9_packing,
    "op10_topk_search": topk.op10_topk_search,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_decontamination": postings.op12_decontamination,
    "op13_token_alignment": tokenpairs.op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_sharding": sharding.SHARDING_SQL,
    "op2_mixing": mixing.MIXING_SQL,
    "op3_warc": warc.WARC_SQL,
    "op8_quality_rules": quality.QUALITY_SQL,
    "op5_chat_formatting": chat.CHAT_SQL,
    "op10_topk_search": topk.TOPK_SQL,
    "op12_decontamination": postings.PHRASE_SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
