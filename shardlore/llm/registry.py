"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardlore.llm import chat, decontaminate, embeddings, licenses, mixing, neardup, repeats, secrets, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_licenses": licenses.query,
        "op3_embeddings": embeddings.query,
        "op4_chat": chat.query,
        "op5_near_duplicates": neardup.query,
        "op6_repeats": repeats.query,
        "op7_sharding": sharding.query,
        "op8_toxicity": toxicity.query,
        "op9_secrets": secrets.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op3_embeddings": embeddings.SQL,
        "op4_chat": chat.SQL,
        "op7_sharding": sharding.SQL,
    }
