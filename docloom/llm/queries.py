"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from docloom.llm import decontaminate, divergence, fill_middle, licenses, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, suffix_array, voronoi_knn, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_sharding": sharding.op4_sharding,
    "op5_suffix_array_dedup": suffix_array.op5_suffix_array_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_warc_derivatives": warc.op7_warc_derivatives,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_voronoi_knn": voronoi_knn.op11_voronoi_knn,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {**line_dedup.ORACLE, **mixing.ORACLE, **voronoi_knn.ORACLE, **fill_middle.ORACLE, **divergence.ORACLE}
