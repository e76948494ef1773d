"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from probity.llm import conversation_repair, decontaminate, embedding_dedup, jaccard_join, lm_scoring, mixing, periodic_runs, quality_qda, secret_scan, suffix_dedup, token_packing, toxicity, warc_index

QUERIES = {
    "op1_warc_index_merge": warc_index.op1_warc_index_merge,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_classifier": quality_qda.op4_quality_classifier,
    "op5_token_packing": token_packing.op5_token_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_embedding_near_dedup": embedding_dedup.op9_embedding_near_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_lm_scoring": lm_scoring.op12_lm_scoring,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {**warc_index.ORACLE, **mixing.ORACLE, **decontaminate.ORACLE, **jaccard_join.ORACLE}
