"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, jaccard, substrings, urls
from .common import table


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_digests(table(spark, sf_dir, "documents"), *vocabulary())


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.dedup(table(spark, sf_dir, "documents")))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(table(spark, sf_dir, "documents"), *vocabulary())


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.digests(media.decode(media.store(table(spark, sf_dir, "documents"))))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.RULES)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(chat.planted(spark))))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_embeddings": op2_embeddings,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_media": op6_media,
    "op7_urls": op7_urls,
    "op8_chat": op8_chat,
    "op9_bpe": op9_bpe,
    "op10_mixing": op10_mixing,
}

ORACLE: dict[str, str] = {
    "op1_substrings": substrings.ORACLE,
    "op2_embeddings": embeddings.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op7_urls": urls.oracle(),
    "op8_chat": chat.ORACLE,
}
