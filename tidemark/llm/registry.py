"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, language, mixing, ngram_jaccard, pii, suffix_dedup, token_files, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard.op1_ngram_jaccard_join,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_topk_search": topk.op3_topk_search,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pii": pii.op5_pii,
        "op6_warc": warc.op6_warc,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_token_ids": token_files.op8_token_ids,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_language_id": language.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard.SQL,
        "op2_mix_sources": mixing.SQL,
        "op3_topk_search": topk.SQL,
    }
