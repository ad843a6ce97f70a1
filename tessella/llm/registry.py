"""The queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from tessella.llm import exact_dedup, language, licences, mixing, packing, paragraphs, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_mix_sources": (mixing.op1_mix_sources, mixing.SQL),
    "op2_exact_dedup": (exact_dedup.op2_exact_dedup, exact_dedup.SQL),
    "op3_exact_topk": (topk.op3_exact_topk, topk.SQL),
    "op4_licences": (licences.op4_licences, licences.SQL),
    "op5_hilbert_shards": (sharding.op5_hilbert_shards, sharding.SQL),
    "op6_language": (language.op6_language, language.SQL),
    "op7_repeated_paragraphs": (paragraphs.op7_repeated_paragraphs, paragraphs.SQL),
    "op8_simhash": (simhash.op8_simhash, simhash.SQL),
    "op9_toxicity": (toxicity.op9_toxicity, toxicity.SQL),
    "op10_harmonic_packing": (packing.op10_harmonic_packing, packing.SQL),
}
