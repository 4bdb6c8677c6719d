"""Queries of this subpackage for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotrain, divergence, imatch, mincut, mixing, near_dups, packing, pii, rans, repeats, rules, sharding, tries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": cotrain.op1_quality_classifier,
    "op2_repeated_strings": repeats.op2_repeated_strings,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_rans_files": rans.op4_rans_files,
    "op5_shard_lookup": sharding.op5_shard_lookup,
    "op6_personal_data": pii.op6_personal_data,
    "op7_near_duplicates": near_dups.op7_near_duplicates,
    "op8_document_fingerprints": imatch.op8_document_fingerprints,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_main_text": mincut.op11_main_text,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_prefix_trie": tries.op13_prefix_trie,
}

#: DuckDB SQL by query; what trained models, hashes or files decide has none and is tested by brute force.
ORACLES: dict[str, str] = {"op12_source_divergence": divergence.SQL}
