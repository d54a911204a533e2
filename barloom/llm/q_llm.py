"""Queries of the operators in this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, fingerprints, mixing, near, neighbours, preference, q_rules, sentences, tokenfiles, toxicity, unigram
from barloom.llm.common import materialise, table
from barloom.session import shared_dir

QUERIES: dict = dict(q_rules.QUERIES)
ORACLE: dict = dict(q_rules.ORACLE)


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


@query("op4_source_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.words_taken(m).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; near_docs: documents within three bits of those whose id
    is divisible by 50, themselves not counted."""
    f = fingerprints.fingerprints_of_edits(table(spark, sf_dir, "documents"))
    f = materialise(f, "fp-all")
    classes = f.groupBy("fp").agg(F.count("*").alias("n"))
    found = (fingerprints.within_radius(classes, f.filter("doc_id % 50 = 0")).join(classes, "fp")
             .groupBy("query_fp").agg((F.sum("n") - 1).alias("near")))
    f = f.join(found, f["fp"] == found["query_fp"], "left")
    return f.select("doc_id", "n_chars", "edited_sha256", fingerprints.hexed(F.col("fp")).alias("fingerprint"),
                    fingerprints.hexed(F.col("edited_fp")).alias("edited_fingerprint"),
                    fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
                    F.when(F.col("doc_id") % 50 == 0, F.col("near")).alias("near_docs"))


OP9 = r"""
WITH t AS (
  SELECT DISTINCT conv_id, conv_id // 2 AS pair_id, turn, replace(coalesce(role, 'user'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
ids AS (
  SELECT pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 <> 0) AS rejected_id,
         count(*) FILTER (conv_id % 2 = 0) AS na, count(*) FILTER (conv_id % 2 <> 0) AS nb FROM placed GROUP BY pair_id),
alike AS (
  SELECT pair_id, i FROM placed GROUP BY pair_id, i
  HAVING count(*) = 2 AND min(role) = max(role) AND min(text) = max(text)),
run AS (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM alike),
prefix AS (SELECT pair_id, count(*) AS n FROM run WHERE i = k GROUP BY pair_id),
marked AS (
  SELECT p.*, coalesce(f.n, 0) AS n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS block
  FROM placed p LEFT JOIN prefix f USING (pair_id)),
timed AS (
  SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM marked WHERE i > n),
spans AS (
  SELECT conv_id, string_agg(block, '' ORDER BY i) AS body,
         string_agg(CASE WHEN role = 'assistant' THEN (ahead + length(role) + 5)::BIGINT::VARCHAR || '-' || (ahead + length(block) - 1)::BIGINT::VARCHAR END, ',' ORDER BY i) AS spans
  FROM timed GROUP BY conv_id),
prompts AS (SELECT conv_id, string_agg(block, '' ORDER BY i) AS prompt FROM marked WHERE i <= n GROUP BY conv_id)
SELECT ids.pair_id, chosen_id, rejected_id, coalesce(f.n, 0) AS n_prompt_turns, coalesce(pr.prompt, '') AS prompt, coalesce(c.body, '') AS chosen,
       coalesce(r.body, '') AS rejected, coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM ids LEFT JOIN prefix f USING (pair_id) LEFT JOIN prompts pr ON pr.conv_id = ids.chosen_id
LEFT JOIN spans c ON c.conv_id = chosen_id LEFT JOIN spans r ON r.conv_id = rejected_id
"""


@query("op9_preference", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) as prompt and masked completions."""
    return preference.formatted(preference.neighbour_pairs(table(spark, sf_dir, "conversations")))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").filter(~out)
    model = toxicity.train(docs.filter(~out), labels)
    return (toxicity.score(docs, model)
            .select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query("op3_sentence_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of runs that an earlier place has."""
    return (sentences.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_sentences", "removed_sentences", "removed_words", "text"))


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by backtracking and decoded again, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to compressed shards and read back."""
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenfiles.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return tokenfiles.read_ids(spark, folder)


@query("op2_piece_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of all documents, over the pieces and scores of the sentencepiece file."""
    return unigram.piece_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op5_nearest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(v, v.filter("vec_id % 100 = 0"))


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document: its smallest doc_id and its size."""
    g = near.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select(F.nullif("doc", F.lit(near.NO_ID)).alias("doc_id"), "group_id", "group_size", F.col("first").cast("int").alias("kept"))
