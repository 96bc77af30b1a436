"""The registered queries of the document operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from batchtally.llm.centroids import OP13_SQL, op13_centroids
from batchtally.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from batchtally.llm.licences import op7_license_scan
from batchtally.llm.lm_score import op8_lm_score
from batchtally.llm.mixing import op9_source_mixing
from batchtally.llm.phrases import OP11_SQL, op11_phrases
from batchtally.llm.pii import op2_pii_spans
from batchtally.llm.quality import OP10_SQL, op10_quality_rules
from batchtally.llm.sentencepiece_sampling import op5_sentencepiece_sampling
from batchtally.llm.sharding import op4_resharding
from batchtally.llm.simhash import op3_simhash_near_dedup
from batchtally.llm.toxicity import op6_toxicity_chain
from batchtally.llm.url_filter import OP12_SQL, op12_url_filter

QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_pii_spans": (op2_pii_spans, None),
    "op3_simhash_near_dedup": (op3_simhash_near_dedup, None),
    "op4_resharding": (op4_resharding, None),
    "op5_sentencepiece_sampling": (op5_sentencepiece_sampling, None),
    "op6_toxicity_chain": (op6_toxicity_chain, None),
    "op7_license_scan": (op7_license_scan, None),
    "op8_lm_score": (op8_lm_score, None),
    "op9_source_mixing": (op9_source_mixing, None),
    "op10_quality_rules": (op10_quality_rules, OP10_SQL),
    "op11_phrases": (op11_phrases, OP11_SQL),
    "op12_url_filter": (op12_url_filter, OP12_SQL),
    "op13_centroids": (op13_centroids, OP13_SQL),
}
