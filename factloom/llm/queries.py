"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, html_text, jaccard, lm, media, pii, sentencepieces, token_counts, toxicity

QUERIES = {
    "op1_sentencepieces": sentencepieces.op1_sentencepieces,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_personal_data": pii.op3_personal_data,
    "op4_media_columns": media.op4_media_columns,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_lm_scores": lm.op6_lm_scores,
    "op7_html_text": html_text.op7_html_text,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
}
