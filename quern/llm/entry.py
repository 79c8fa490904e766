"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from quern.llm import chat, decontaminate, fingerprint, html_text, line_dedup, oracle, packing, simhash, token_count, toxicity, url_rules


def queries():
    return {
        "op1_fingerprints": fingerprint.op1_fingerprints,
        "op2_html_text": html_text.op2_html_text,
        "op3_simhash": simhash.op3_simhash,
        "op4_packing": packing.op4_packing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_url_rules": url_rules.op7_url_rules,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_chat_format": chat.op9_chat_format,
        "op10_token_counts": token_count.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_rules": oracle.url_sql(), "op8_decontaminate": oracle.leak_sql(), "op9_chat_format": oracle.chat_sql()}
