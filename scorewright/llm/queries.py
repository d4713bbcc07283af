"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import conversations, embed_dedup, exact_dedup, filter_audit, langid, minhash, mixing, packing, pieces, pii, sharding, token_files, warc

QUERIES = {
    "op1_feistel_pseudonyms": pii.op1_feistel_pseudonyms,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_simple8b_token_files": token_files.op3_simple8b_token_files,
    "op4_embedding_dedup": embed_dedup.op4_embedding_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_two_pass_sharding": sharding.op7_two_pass_sharding,
    "op8_sum_of_squares_packing": packing.op8_sum_of_squares_packing,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_splittable_warc": warc.op10_splittable_warc,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op2_minhash_near_dedup": minhash.OP2_SQL,
    "op4_embedding_dedup": embed_dedup.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op10_splittable_warc": warc.OP10_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
