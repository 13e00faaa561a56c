"""A corpus from raw documents to token ids: five stages, each an operator's decisions taking effect on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import mixing, pieces, simhash, substring, toxicity
from terrace.llm._common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; all others stay as they are."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays. Rows with a null doc_id stay, as they can't be told to be one document; rows that repeat a doc_id stay or go together."""
    first = simhash.near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs["doc_id"] == first["_first"], "left_semi").unionAll(docs.where("doc_id is null"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of an earlier document are cut out of the texts."""
    return substring.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target mixture takes them."""
    return mixing.mix(docs, mixing.DOMAINS, mixing.WEIGHTS, mixing.SHARE_PERCENT, mixing.MAX_EPOCHS, mixing.SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, digested, and what they decode to."""
    return pieces.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring", drop_passages), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The models, classes of near copies, passages and ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
