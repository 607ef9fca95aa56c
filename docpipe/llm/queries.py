"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from docpipe.llm import decontamination, extraction, jaccard, language, maxent, mixing, quality, repetition, search, sharding, spelling, tokens, vectors

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_language_id": language.query,
    "op3_maxent_lm": maxent.query,
    "op4_suffix_repetition": repetition.query,
    "op5_additive_quality": quality.query,
    "op6_page_wrappers": extraction.query,
    "op7_byte_bpe": tokens.query,
    "op8_minhash_jaccard": jaccard.query,
    "op9_minimax_sharding": sharding.query,
    "op10_subspace_pigeonhole": vectors.query,
    "op11_positional_index": decontamination.query,
    "op12_bloom_neighbourhoods": spelling.query,
    "op13_accumulator_search": search.query,
}

SQL = {
    "op1_source_mixing": mixing.SQL,
    "op4_suffix_repetition": repetition.SQL,
    "op6_page_wrappers": extraction.SQL,
    "op8_minhash_jaccard": jaccard.SQL,
    "op9_minimax_sharding": sharding.SQL,
    "op10_subspace_pigeonhole": vectors.SQL,
    "op11_positional_index": decontamination.SQL,
    "op12_bloom_neighbourhoods": spelling.SQL,
    "op13_accumulator_search": search.SQL,
}
