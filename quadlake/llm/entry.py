"""The corpus operators' queries and their SQL; __spark_entry__ adds them where this subpackage is present."""

from __future__ import annotations

from . import exact_dedup, matroska, mixing, packing, pii, sharding, simhash, suffix_dedup, token_files, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_matroska_media": matroska.op2,
        "op3_token_files": token_files.op3,
        "op4_suffix_arrays": suffix_dedup.op4,
        "op5_simhash_bk_trees": simhash.op5,
        "op6_rendezvous_shards": sharding.op6,
        "op7_sum_of_squares_packing": packing.op7,
        "op8_exact_dedup": exact_dedup.op8,
        "op9_weak_supervision": toxicity.op9,
        "op10_information_sanitisation": pii.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.OP8_SQL}
