"""The queries of this package, by name, and their SQL where it can express them."""

from __future__ import annotations

from facetline.llm import bpe, jaccard, licenses, lm, packing, passages, pii, quality, urls, vectors


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_redirect_filter": urls.op3_redirect_filter,
        "op4_multi_index": vectors.op4_multi_index,
        "op5_collinear_chains": passages.op5_collinear_chains,
        "op6_multi_order_join": jaccard.op6_multi_order_join,
        "op7_surrogates": pii.op7_surrogates,
        "op8_conditional_compression": licenses.op8_conditional_compression,
        "op9_best_two_fit": packing.op9_best_two_fit,
        "op10_context_tree": lm.op10_context_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_redirect_filter": urls.SQL}
