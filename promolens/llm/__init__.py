"""Corpus operators for training data.  Nothing else in the library imports
this package; ``__spark_entry__.py`` adds its queries when it is there."""

from __future__ import annotations

from collections.abc import Callable


def queries() -> dict[str, Callable]:
    from promolens.llm import hmm_lm, importance, jaccard_join, line_join, merkle, packing, pair_bitmaps, pfp_dedup, quality_llr, sentencepiece_dropout, template_decon, url_rules, warc_chain
    return {
        "op6_hmm_scores": hmm_lm.op6_hmm_scores,
        "op7_template_leaks": template_decon.op7_template_leaks,
        "op8_line_join": line_join.op8_line_join,
        "op5_ngram_jaccard": jaccard_join.op5_ngram_jaccard,
        "op1_url_rules": url_rules.op1_url_rules,
        "op2_importance_resampling": importance.op2_importance_resampling,
        "op3_prefix_free_dedup": pfp_dedup.op3_prefix_free_dedup,
        "op4_quality_llr": quality_llr.op4_quality_llr,
        "op9_warc_chain": warc_chain.op9_warc_chain,
        "op10_sentencepiece": sentencepiece_dropout.op10_sentencepiece,
        "op11_best_two_fit": packing.op11_best_two_fit,
        "op12_pair_bitmaps": pair_bitmaps.op12_pair_bitmaps,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from promolens.llm import warc_chain
    return {
        "op9_warc_chain": warc_chain.ORACLE,
    }
