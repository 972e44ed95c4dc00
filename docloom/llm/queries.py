"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import exact_dedup, mixing, ngram_join, pii, quality, sentencepiece_codec, sharding, suffix_dedup, topk, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
}

ORACLES = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op6_exact_topk": topk.OP6_SQL,
    "op7_warc_revisits": warc.OP7_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
}
