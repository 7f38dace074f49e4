"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import oracle
from .bitplane import op6_token_bitplanes
from .chat import chat_mixed_layouts, op3_schema_fingerprint_chat
from .embeddings import op9_pca_tiles
from .fmindex import op2_fm_index_decontamination
from .impact import op12_impact_ordered_search
from .langid import op7_rank_order_language
from .license import op8_license_paragraphs
from .minhash import op10_fast_similarity_sketch
from .mixing import mix_targets, op13_splitting_tree_mix
from .packing import op1_nnls_packing
from .periodic import op11_harmonic_runs
from .quality import op4_compression_quality
from .superkmer import op5_superkmer_dedup

QUERIES = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_fm_index_decontamination": op2_fm_index_decontamination,
    "op3_schema_fingerprint_chat": op3_schema_fingerprint_chat,
    "chat_mixed_layouts": chat_mixed_layouts,
    "op4_compression_quality": op4_compression_quality,
    "op5_superkmer_dedup": op5_superkmer_dedup,
    "op6_token_bitplanes": op6_token_bitplanes,
    "op7_rank_order_language": op7_rank_order_language,
    "op8_license_paragraphs": op8_license_paragraphs,
    "op9_pca_tiles": op9_pca_tiles,
    "op10_fast_similarity_sketch": op10_fast_similarity_sketch,
    "op11_harmonic_runs": op11_harmonic_runs,
    "op12_impact_ordered_search": op12_impact_ordered_search,
    "op13_splitting_tree_mix": op13_splitting_tree_mix,
    "mix_targets": mix_targets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_fm_index_decontamination": oracle.OP2,
    "op3_schema_fingerprint_chat": oracle.OP3,
    "chat_mixed_layouts": oracle.CHAT_MIXED,
    "op5_superkmer_dedup": oracle.OP5,
    "op7_rank_order_language": oracle.OP7,
    "op9_pca_tiles": oracle.OP9,
    "op10_fast_similarity_sketch": oracle.OP10,
    "op11_harmonic_runs": oracle.OP11,
    "op12_impact_ordered_search": oracle.OP12,
    "mix_targets": oracle.MIX_TARGETS,
}
