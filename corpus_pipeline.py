"""A training-corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding.

Each stage takes all that its predecessor kept, and its decisions take effect; all but the last return the columns of
documents. Between stages the rows are written to the shared folder and read again, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkassay.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece_codec, shared
from sparkassay.sources import scratch

#: Share that the likeliest language must have at least; with four languages only texts that fit none fall below.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely language go."""
    return language_id.keep_known(docs, language_id.fit(docs), LEAST_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the one with the largest doc_id only."""
    return line_dedup.keep_first(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle Jaccard similarity of 0.8 the one with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    import public_tokenizers

    return sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the network nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of ``documents``. A stage's own tables are removed once its rows are written, and those once the next stage has read them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch.scope(spark) as kept:
            docs = shared.materialize(stage(spark, docs, sf_dir), name)
        scratch.remove(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
