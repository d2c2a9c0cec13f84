"""Queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import ann, byte_bpe, code_compression, hard_negatives, lattice_sampling, license_scan, packing, pii, quality_classifier, quality_rules, sharding, simhash_dedup, suffix_dedup


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": pii.op1_pii,
        "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_sharding": sharding.op5_sharding,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_lattice_sampling": lattice_sampling.op7_lattice_sampling,
        "op8_ann": ann.op8_ann,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_packing": packing.op10_packing,
        "op11_code_compression": code_compression.op11_code_compression,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.oracle(), "op11_code_compression": code_compression.oracle(), "op12_hard_negatives": hard_negatives.oracle()}
