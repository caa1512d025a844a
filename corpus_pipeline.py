"""Corpus pipeline: five of the operators in a row, each on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import bpe, jaccard, mixing, secrets, toxicity
from tidefold.llm.common import cut_lineage, table
from tidefold.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: words to a shingle and similarity as a fraction. op5's own values bind only that query.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go. Trained on labels that aren't held out."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, net).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 or more of five-word shingles the one of the smallest doc_id stays."""
    groups = jaccard.join_components(docs, SHINGLE, NUMERATOR, DENOMINATOR)
    return jaccard.keep_first(docs, groups).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text becomes a mask."""
    out = secrets.redact(docs, *vocabulary())
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, with the words that pass takes."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of every row of the mix."""
    return bpe.encode_digests(docs, *vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: A trained network, seeded draws and BPE can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
