"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's rows as Parquet in the shared folder and reads them as the next one's input.
No stage has an SQL form (learnt weights, BPE), so tests compare with brute force.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, pii, toxicity
from tidemark.llm.common import is_present, lean_batches, presence, read_table, stage_table
from tidemark.llm.queries import TOKENIZERS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model learnt from ``labels`` outside the held-out fifth.
    Null and empty texts score as a text without features, which no rule rejects in a corpus of
    mostly clean texts. Without a training row (no labels, or only null, held-out or foreign ones)
    the model is empty and tells nothing of any text: every document stays."""
    labels = read_table(spark, sf_dir, "labels")
    lean_batches(spark)
    model = toxicity.fit(docs, labels.where(~F.coalesce(toxicity.held_out(), F.lit(True))))
    return toxicity.reject(docs, model) if len(model[0]) else docs


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of five-word shingle sets with a
    similarity of 0.8 or more. Rows that repeat an id stay or go together; a null id stays."""
    lean_batches(spark)
    found = jaccard.components(docs, width=5, percent=80)     # its own columns only: the texts join once, below
    gone = stage_table(found.where("doc_id > component_id").select("doc_id").distinct(), "near-copies")
    # only texts that a bitmap of fixed size takes for copies go through the join; the join decides
    bits = presence(gone.select(F.xxhash64("doc_id").alias("h")), "h")
    perhaps = F.pandas_udf(lambda h: pd.Series(is_present(bits.value, h.to_numpy())), "boolean")(F.xxhash64("doc_id"))
    return docs.where(~perhaps).union(docs.where(perhaps).join(gone, "doc_id", "left_anti").select(docs.columns))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; a document with nothing else goes."""
    out = decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"), length_col="n_chars" if "n_chars" in docs.columns else None)
    lean_batches(spark)
    return out


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind; every document stays."""
    lean_batches(spark)
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, decoded_sha256 and the token ids of every document."""
    spec = bpe.vocabulary(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    lean_batches(spark)
    return bpe.encode(docs, spec, digest="decoded")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", cut_benchmark),
          ("pii", redact_pii), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
