"""The queries of this subpackage, over whole tables with production parameters, and their oracles."""

from __future__ import annotations

from graphlode.llm import decontaminate, fingerprints, langid, mixing, neardup, sharding, substrings, tokenids, toxicity, warc

QUERIES = {
    "op10_warc_transactions": warc.op10_warc_transactions,
    "op3_token_ids": tokenids.op3_token_ids,
    "op4_langid": langid.op4_langid,
    "op6_substrings": substrings.op6_substrings,
    "op5_sharding": sharding.op5_sharding,
    "op7_mixing": mixing.op7_mixing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op9_neardup": neardup.op9_neardup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op1_winnowing": fingerprints.op1_winnowing,
}
ORACLES = {
    "op10_warc_transactions": warc.SQL,
    "op6_substrings": substrings.SQL,
    "op5_sharding": sharding.SQL,
    "op4_langid": langid.SQL,
    "op7_mixing": mixing.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op1_winnowing": fingerprints.SQL,
}
