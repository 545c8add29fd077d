"""The queries of this package and, where SQL can express them, the SQL."""

from __future__ import annotations

from . import ann, packing, quality, secrets, sentencepiece_codec, sharding, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secrets": secrets.op3_secrets,
    "op4_ann": ann.op4_ann,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality": quality.op6_quality,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_packing": packing.op9_packing,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": url_filter.ORACLE_SQL,
}
