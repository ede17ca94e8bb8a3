"""Queries of the training-data operators, and their checking SQL."""

from . import bpe, html_blocks, license_scan, merkle, mixing, near_dedup, nearest, personal_data, quality_rules, spelling, suffix_dedup, toxicity, weak_quality

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op10_weak_quality": weak_quality.op10_weak_quality,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_nearest_neighbours": nearest.op7_nearest_neighbours,
    "op8_personal_data": personal_data.op8_personal_data,
    "op9_toxicity": toxicity.op9_toxicity,
    "op11_html_extraction": html_blocks.op11_html_extraction,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op1_license_scan": license_scan.SQL,
    "op2_suffix_array_dedup": suffix_dedup.SQL,
    "op3_minhash_near_dedup": near_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_mix_sources": mixing.SQL,
    "op7_nearest_neighbours": nearest.SQL,
    "op11_html_extraction": html_blocks.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
