"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_mixing, op2_minhash, op3_nn_descent, op4_chat, op5_substring, op6_language, op7_mixing_lm, op8_pii, op9_quality, op10_packing

QUERIES = {
    "op1_pfair_mixing": op1_mixing.op1_pfair_mixing,
    "op2_minhash_near_dedup": op2_minhash.op2_minhash_near_dedup,
    "op3_nn_descent": op3_nn_descent.op3_nn_descent,
    "op4_chat_format": op4_chat.op4_chat_format,
    "op5_paragraph_dedup": op5_substring.op5_paragraph_dedup,
    "op6_language_ecoc": op6_language.op6_language_ecoc,
    "op7_context_mixing_lm": op7_mixing_lm.op7_context_mixing_lm,
    "op8_pii_semi_markov": op8_pii.op8_pii_semi_markov,
    "op9_weak_quality": op9_quality.op9_weak_quality,
    "op10_best_fit_packing": op10_packing.op10_best_fit_packing,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op4_chat_format": op4_chat.OP4_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
