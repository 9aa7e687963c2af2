"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from trawl.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, license_scan, merkle, mixing, near_dedup, periodic_runs, secrets, sentencepiece, sharding, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_sharding": sharding.op2_sharding,
    "op3_sentencepiece": sentencepiece.op3_sentencepiece,
    "op4_language_id": language_id.op4_language_id,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op8_license_notices": license_scan.op8_license_notices,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op5_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_license_scan": license_scan.oracle_sql(),
    "op13_merkle": merkle.oracle_sql(),
}
