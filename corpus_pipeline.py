"""The corpus pipeline: five stages, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. Stages filter or
rewrite documents and keep their columns; the last one returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, common, decontaminate, jaccard, langid, secretscan
from quillon.llm.queries import vocabulary

#: Below this score a language counts as not recognised.
LEAST_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter, or no model is near) go; lang may be null."""
    return langid.keep_known(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    Documents without a word are in no group and stay, as do rows without an id and
    rows that repeat a kept id.
    """
    return jaccard.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, straight or reordered, go; null and empty texts hold none."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; every document stays, a null text as null."""
    return secretscan.redact(docs, secretscan.fit())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of them and of what they decode to; a null text has no ids."""
    return bpe.encode_documents(
        docs,
        vocabulary("word_bpe_49k.json"),
        project=lambda use, ids, decoded: (ids, *bpe.digest(use, ids, decoded)),
        ddl="doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("BPE encoding and decoding", encode),
]

#: No SQL: language models, networks and vocabularies; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder, and deleted when the next one is there."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs)
            if before is not None:
                common.forget(before)
            before = docs
    return docs
