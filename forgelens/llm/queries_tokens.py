"""Queries of the tokenizer and mixing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.llm import bpe, mixing
from forgelens.session import cut, table


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document, empty and null texts included."""
    return bpe.encode(table(spark, sf, "documents", "doc_id", "text"))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether decoding gives back the text; null texts come back empty."""
    documents = table(spark, sf, "documents", "doc_id", "text")
    back = bpe.encode(documents).select("doc_id", bpe.decode(F.col("ids")).alias("decoded"))
    return documents.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf, "documents", "doc_id", "text", "source")
    targets = table(spark, sf, "mix_targets", "source", "target_share", "max_repeats")
    aimed = documents.join(targets.select("source").distinct(), "source", "left_semi")  # broadcast only if its size allows
    sized = cut(bpe.encode(aimed, keep=("source",)).select("doc_id", "source", F.size("ids").cast("long").alias("tokens")))
    return mixing.mix(sized, targets)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(*_mixed(spark, sf))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLES = {"p8_roundtrip": "select doc_id, true same from documents"}
