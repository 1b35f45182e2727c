"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, media_gif, minhash, mixing, pii, quality, token_counts, token_files, toxicity
from .common import prepare

Query = Callable[[SparkSession, str], DataFrame]


def prepared(query: Query) -> Query:
    """The query, in a prepared session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    name: prepared(query)
    for name, query in {
        "op1_embedding_neardup": embed_dedup.query,
        "op2_pii": pii.query,
        "op3_token_counts": token_counts.query,
        "op4_media_gif": media_gif.query,
        "op5_bpe": bpe.query,
        "op6_mixing": mixing.query,
        "op7_minhash": minhash.query,
        "op8_quality": quality.query,
        "op9_token_files": token_files.query,
        "op10_toxicity": toxicity.query,
        "media_payloads": media_gif.payloads,
        "pii_counts": pii.counts,
    }.items()
}
ORACLE: dict[str, str] = {
    "op1_embedding_neardup": embed_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_minhash": minhash.ORACLE,
    "media_payloads": media_gif.ORACLE_PAYLOADS,
    "pii_counts": pii.ORACLE_COUNTS,
}
