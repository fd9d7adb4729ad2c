"""The queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, fuzzy_dedup, language_id, licences, near_dedup, neighbours, packing, periodic_runs, quality, secrets, sharding, vector_codes

QUERIES = {
    "op1_quality_cotraining": quality.op1_quality_cotraining,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_license_scan": licences.op4_license_scan,
    "op5_sharding": sharding.op5_sharding,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_nearest_neighbours": neighbours.op10_nearest_neighbours,
    "op11_simhash_near_dedup": fuzzy_dedup.op11_simhash_near_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op4_license_scan": licences.sql(),
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
