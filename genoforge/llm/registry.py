"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import exact_dedup, hard_negatives, html_extract, jaccard_join, language, licenses, lm_scoring, media, mixing, packing, quality, substring_dedup, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality": quality.op2_quality,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_media_copies": media.op6_media_copies,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_packing": packing.op8_packing,
    "op9_language": language.op9_language,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_lm_scoring": lm_scoring.op12_lm_scoring,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {"op1_exact_dedup": exact_dedup.SQL, "op3_mix_sources": mixing.SQL, "op11_hard_negatives": hard_negatives.SQL}
