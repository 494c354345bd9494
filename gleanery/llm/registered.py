"""The corpus operators as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gleanery.llm import (
    bpe_transducer,
    centroid_clusters,
    decontaminate,
    exact_dedup,
    line_dedup,
    minhash_dedup,
    mixing,
    phrases,
    quality,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_output,
)
from gleanery.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, folder: operator(*[read_table(spark, folder, t) for t in tables])


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": _over(sharding.op1_sharding, "documents"),
        "op2_suffix_dedup": _over(suffix_dedup.op2_suffix_dedup, "documents"),
        "op3_decontaminate": _over(decontaminate.op3_decontaminate, "documents", "benchmark"),
        "op4_exact_dedup": _over(exact_dedup.op4_exact_dedup, "documents"),
        "op5_quality_crf": _over(quality.op5_quality_crf, "documents", "labels"),
        "op6_token_output": _over(token_output.op6_token_output, "documents"),
        "op7_substring_dedup": _over(substring_dedup.op7_substring_dedup, "documents"),
        "op8_mixing": _over(mixing.op8_mixing, "documents"),
        "op9_line_dedup": _over(line_dedup.op9_line_dedup, "documents"),
        "op10_minhash_dedup": _over(minhash_dedup.op10_minhash_dedup, "documents"),
        "op11_centroid_clusters": _over(centroid_clusters.op11_centroid_clusters, "embeddings"),
        "op12_bpe_transducer": _over(bpe_transducer.op12_bpe_transducer, "documents"),
        "op13_phrases": _over(phrases.op13_phrases, "documents"),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL with the same result, for the queries that SQL can express."""
    return {
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_centroid_clusters": centroid_clusters.OP11_SQL,
        "op13_phrases": phrases.OP13_SQL,
    }
