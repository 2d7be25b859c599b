"""The registered queries of this subpackage, and SQL for those SQL can express."""

from __future__ import annotations

from batchwright.llm import (
    bpe, chat, dac, decontaminate, importance, jaccard, langid, lexical, pii, quality, secrets, topk, toxicity)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_dac_tokens": dac.op3_dac_tokens,
    "op4_chat_rotation": chat.op4_chat_rotation,
    "op5_language_id": langid.op5_language_id,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_quality": quality.op8_quality,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_pii": pii.op11_pii,
    "op12_importance": importance.op12_importance,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {**chat.ORACLES, **decontaminate.ORACLES, **importance.ORACLES, **jaccard.ORACLES,
           **lexical.ORACLES, **topk.ORACLES}
