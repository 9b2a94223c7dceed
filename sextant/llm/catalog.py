"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from sextant.llm.alignment import op13_cross_alignment
from sextant.llm.compression import op9_quality_compression
from sextant.llm.language_mix import op10_language_mixture
from sextant.llm.lattice import op2_lattice_likelihood
from sextant.llm.licences import op6_licence_scan
from sextant.llm.line_rules import ORACLE as LINE_SQL
from sextant.llm.line_rules import op3_line_rules
from sextant.llm.merkle import ORACLE as MERKLE_SQL
from sextant.llm.merkle import op12_merkle_manifest
from sextant.llm.pii import op7_pii_boosted
from sextant.llm.similarity import ORACLE as JACCARD_SQL
from sextant.llm.similarity import op4_jaccard_join
from sextant.llm.temperature import ORACLE as MIX_SQL
from sextant.llm.temperature import op5_temperature_mix
from sextant.llm.tiling import op8_benchmark_tiling
from sextant.llm.topk import ORACLE as TOPK_SQL
from sextant.llm.topk import op11_exact_topk
from sextant.llm.weak_labels import op1_toxicity_weak

QUERIES = {
    "op1_toxicity_weak": op1_toxicity_weak,
    "op2_lattice_likelihood": op2_lattice_likelihood,
    "op3_line_rules": op3_line_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_temperature_mix": op5_temperature_mix,
    "op6_licence_scan": op6_licence_scan,
    "op7_pii_boosted": op7_pii_boosted,
    "op8_benchmark_tiling": op8_benchmark_tiling,
    "op9_quality_compression": op9_quality_compression,
    "op10_language_mixture": op10_language_mixture,
    "op11_exact_topk": op11_exact_topk,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_cross_alignment": op13_cross_alignment,
}

ORACLES: dict[str, str] = {
    "op3_line_rules": LINE_SQL,
    "op4_jaccard_join": JACCARD_SQL,
    "op5_temperature_mix": MIX_SQL,
    "op11_exact_topk": TOPK_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
}
