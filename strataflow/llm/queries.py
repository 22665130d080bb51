"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import langid, mixing, neardup, pieces, quality, secrets, sharding, topk, toxicity, warc
from strataflow.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_neardup": neardup.op2_neardup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_langid": langid.op4_langid,
    "op5_pieces": pieces.op5_pieces,
    "op6_mixing": mixing.op6_mixing,
    "op7_topk": topk.op7_topk,
    "op8_warc": warc.op8_warc,
    "op9_secrets": secrets.op9_secrets,
    "op10_quality": quality.op10_quality,
}

__all__ = ["ORACLES", "QUERIES"]
