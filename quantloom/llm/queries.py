"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from quantloom.llm import line_dedup, media, mixing, phrase_dedup, quality_rules, segmentation, sharding, simhash, toxicity, url_filter

QUERIES: dict[str, Callable] = {
    "op1_segmentation": segmentation.query,
    "op2_phrase_dedup": phrase_dedup.query,
    "op3_url_filter": url_filter.query,
    "op4_simhash": simhash.query,
    "op5_sharding": sharding.query,
    "op6_line_dedup": line_dedup.query,
    "op7_media": media.query,
    "op8_quality_rules": quality_rules.query,
    "op9_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
}
SQL = {"op3_url_filter": url_filter.SQL, "op6_line_dedup": line_dedup.SQL}
