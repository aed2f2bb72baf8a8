"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from churnlens.llm import decontaminate, jaccard, merkle, mixing, phrases, sharding, suffixes
from churnlens.llm.binary import op10_token_files
from churnlens.llm.language import op6_language_id
from churnlens.llm.licenses import op1_license_scan
from churnlens.llm.quality import op2_quality_classifier
from churnlens.llm.rules import op3_quality_rules
from churnlens.llm.tokens import op8_token_counts

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_token_files": op10_token_files,
    "op11_phrases": phrases.op11_phrases,
    "op12_feistel_shards": sharding.op12_feistel_shards,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": jaccard.ORACLE,
    "op5_suffix_dedup": suffixes.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_feistel_shards": sharding.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
