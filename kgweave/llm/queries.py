"""The corpus operators' queries by name, and their SQL where SQL can say them."""

from __future__ import annotations

from . import fingerprints, html, jpeg, language, mixing, neardup, packing, private, sharding, toxicity

QUERIES = {
    "op1_toxicity_factorization_machine": toxicity.op1_toxicity_factorization_machine,
    "op2_progressive_jpeg_media": jpeg.op2_progressive_jpeg_media,
    "op3_lsh_forest_near_duplicates": neardup.op3_lsh_forest_near_duplicates,
    "op4_simhash_fingerprints": fingerprints.op4_simhash_fingerprints,
    "op5_html_main_text": html.op5_html_main_text,
    "op6_kd_tree_shards": sharding.op6_kd_tree_shards,
    "op7_language_bigru": language.op7_language_bigru,
    "op8_pii_weak_supervision": private.op8_pii_weak_supervision,
    "op9_pack_windows": packing.op9_pack_windows,
    "op10_mix_sources": mixing.op10_mix_sources,
}

ORACLES = {"op10_mix_sources": mixing.ORACLE}
