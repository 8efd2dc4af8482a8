"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from . import feistel, fingerprints, lang_id, lattice_lm, licenses, mixing, near_dup, oracles, pieces, quality_gbt, quality_rules, suffix_dedup, vector_codes, whitening

QUERIES = {
    "op1_lattice_likelihood": lattice_lm.op1_lattice_likelihood,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_feistel_shards": feistel.op3_feistel_shards,
    "op4_repeated_strings": suffix_dedup.op4_repeated_strings,
    "op5_near_duplicates": near_dup.op5_near_duplicates,
    "op6_pieces": pieces.op6_pieces,
    "op7_scaled_sketches": fingerprints.op7_scaled_sketches,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_quality_trees": quality_gbt.op9_quality_trees,
    "op10_licenses": licenses.op10_licenses,
    "op11_compressed_languages": lang_id.op11_compressed_languages,
    "op12_exact_whitening": whitening.op12_exact_whitening,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

#: The others rest on seeded hashes, models or vocabularies that DuckDB has not; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
