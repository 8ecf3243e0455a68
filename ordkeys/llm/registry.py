"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from ordkeys.llm import chat, decontam, mixing, neardup, quality, recurrent, rules, sharding, tokens, warc


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_chat_perspectives": chat.op2_chat_perspectives,
        "op3_warc_transactions": warc.op3_warc_transactions,
        "op4_shard": sharding.op4_shard,
        "op5_recurrent_lm": recurrent.op5_recurrent_lm,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_near_duplicates": neardup.op10_near_duplicates,
    }


def oracle_sql():
    return {
        "op1_mix_sources": mixing.SQL,
        "op2_chat_perspectives": chat.SQL,
        "op3_warc_transactions": warc.SQL,
        "op4_shard": sharding.SQL,
        "op9_decontaminate": decontam.SQL,
        "op10_near_duplicates": neardup.SQL,
    }
