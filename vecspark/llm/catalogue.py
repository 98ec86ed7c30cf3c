"""The registered queries of this subpackage and their SQL."""

from vecspark.llm import exact_dedup, media, mixing, packing, quality, secrets, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_warc": warc.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_image_copies": media.query,
    "op6_toxicity": toxicity.query,
    "op7_mixing": mixing.query,
    "op8_quality_classifier": quality.query,
    "op9_secret_scan": secrets.query,
    "op10_packing": packing.query,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
}
