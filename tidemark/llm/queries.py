"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import (ballcodes, bpe, collocations, decontaminate, html, jaccard, licenses, minhash, pii, quality,
                          sharding, suffixes, toxicity)
from tidemark.llm.common import read_table

#: Folder of the public tokenizers' vocabulary files: that of the installed package unless ``TOKENIZER_DIR`` names another.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op1_pii(spark, sf_dir):
    """Personal data in every whole text of ``documents``."""
    return pii.report(read_table(spark, sf_dir, "documents"))


def op2_html(spark, sf_dir):
    """Main text of every page."""
    return html.extract(read_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark, sf_dir):
    """Words of ``documents`` inside ten-word windows of ``benchmark``."""
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_quality(spark, sf_dir):
    """Base statistics and the verdict of the risk-controlled rules."""
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_jaccard(spark, sf_dir):
    """Components of documents whose sets of 4-word shingles reach a Jaccard similarity of 0.85."""
    return jaccard.components(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_toxicity(spark, sf_dir):
    """Toxicity scores, learnt outside the held-out fifth."""
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_licenses(spark, sf_dir):
    """License phrases and template matches of every whole text."""
    return licenses.scan(read_table(spark, sf_dir, "documents")).withColumn("n_matches", F.size("matches")).drop("matches")


def op8_bpe(spark, sf_dir):
    """Token ids and their decoding for every whole text."""
    spec = bpe.vocabulary(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    return bpe.encode(read_table(spark, sf_dir, "documents"), spec, digest=True)


def op9_sharding(spark, sf_dir):
    """All documents in eight shards along a Hilbert curve."""
    return sharding.shards(read_table(spark, sf_dir, "documents"), 8)


def op10_suffixes(spark, sf_dir):
    """Bytes of every text covered by a 400-byte string that starts anywhere else too."""
    return suffixes.removal(read_table(spark, sf_dir, "documents"), 400)


def op11_vector_codes(spark, sf_dir):
    """Codes of eight parts by ball k-means codebooks of 16 entries."""
    return ballcodes.encode(read_table(spark, sf_dir, "embeddings"))


def op12_minhash(spark, sf_dir):
    """Near-duplicate groups at a Jaccard similarity of 0.85 of 3-word shingles."""
    return minhash.groups(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op13_collocations(spark, sf_dir):
    """Each language's first 2,000 phrases of two and three words."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_html, op3_decontaminate, op4_quality, op5_jaccard, op6_toxicity,
                                   op7_licenses, op8_bpe, op9_sharding, op10_suffixes, op11_vector_codes, op12_minhash, op13_collocations)}

ORACLE = {"op3_decontaminate": decontaminate.ORACLE_SQL, "op5_jaccard": jaccard.ORACLE_SQL,
          "op11_vector_codes": ballcodes.oracle_sql(), "op12_minhash": minhash.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
