"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from planproof.llm import audio, bagminhash, decontam, lm_scoring, packing, pii, quality, toxicity, training_order, url_vocab
from planproof.llm.common import table

QUERIES = {
    "op1_quality": lambda s, d: quality.classify(table(s, d, "documents"), table(s, d, "labels")),
    "op2_training_order": lambda s, d: training_order.materialised(table(s, d, "documents")),
    "op3_cross_entropy_difference": lambda s, d: lm_scoring.cross_entropy_difference(table(s, d, "documents"), table(s, d, "labels")),
    "op4_decontamination": lambda s, d: decontam.pairs(table(s, d, "documents"), table(s, d, "benchmark")),
    "op5_bagminhash": lambda s, d: bagminhash.groups(table(s, d, "documents")),
    "op6_toxicity": lambda s, d: toxicity.classify(table(s, d, "documents"), table(s, d, "labels")),
    "op7_url_filter": lambda s, d: url_vocab.judge(table(s, d, "pages")),
    "op8_best_fit_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op9_pii": lambda s, d: pii.report(table(s, d, "documents")),
    "op10_audio": lambda s, d: audio.materialised(table(s, d, "documents")),
}
ORACLES = {"op7_url_filter": url_vocab.oracle()}
