"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import chat, gif, lines, mixing, packing, quality, simhash, topk, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_gif": gif.op1_gif,
        "op2_top_inner_products": topk.op2_top_inner_products,
        "op3_prefix_targets": chat.op3_prefix_targets,
        "op4_source_mix": mixing.op4_source_mix,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_url_rules": urls.op7_url_rules,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_pack": packing.op10_pack,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_top_inner_products": topk.SQL,
        "op3_prefix_targets": chat.SQL,
        "op4_source_mix": mixing.SQL,
        "op8_line_dedup": lines.SQL,
    }
