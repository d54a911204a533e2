"""The corpus pipeline over `documents`: toxic documents go, one document of each near-duplicate group stays, repeated runs of sentences go,
sources are mixed to their target weights, and what remains is encoded and decoded.

Each stage takes the rows that the one before it kept and returns the columns of documents; the last adds digests of ids and text.
SQL can't express the stages; tests compare each with a plain version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, mixing, near, sentences, toxicity
from barloom.llm.common import table
from barloom.session import shared_dir

ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half. Learns from the documents and labels outside the held-out fifth."""
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out))
    return toxicity.score(docs, model).filter("score < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return near.deduplicated(docs)


def spans_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of runs that an earlier place has; n_chars counted anew. A document that loses all its words goes."""
    kept = sentences.deduplicated(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.filter("removed_sentences = 0 or length(trim(text)) > 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row per document and pass, with the words taken. Blocks of 256 words."""
    return mixing.mixed_documents(docs, mixing.mix(docs, block_words=256))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_chars and the digests of ids and decoded text."""
    return (bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))
            .select("doc_id", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_out), ("sentence_spans", spans_out), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; between them, rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
