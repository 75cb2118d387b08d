"""A corpus pipeline of five operators; each stage works on all that its predecessor kept.

Every stage takes null columns, null or repeated ids, empty and very long texts, repeated rows, empty tables, and extra
columns, which the filtering stages hand on (names that begin with __ are the stages' own). Results: an empty table stays
empty; a null text has no words, so the quality rules reject it; rows are told apart by a key of their own, never by
doc_id; ties go by the smaller doc_id (nulls last), then by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import mixing, order_minhash, piece_codec, quality, secret_scan
from wayloom.llm.common import materialize, read, unwritten, with_rows
from wayloom.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail an enforced rule go. Rules look at a row's text alone, so repeated rows stay or go together."""
    return quality.filter_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (nulls last), once; rows are told apart by a key of their own."""
    docs = with_rows(docs)
    judged = order_minhash.near_classes(docs.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "class_id")
    judged = materialize(judged.join(docs.select("__row", "doc_id").hint("merge"), "__row"), "judged")
    first = judged.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("m"))
    lost = judged.join(first.hint("merge"), "class_id").where(F.col("__row") != F.col("m.__row")).select("__row")
    return docs.join(lost.hint("merge"), "__row", "left_anti").select(*[c for c in docs.columns if c != "__row"])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked and n_chars recounted; every row stays, those with null or repeated ids too."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of which the mix takes half of the document or more, sorted by virtual finish time over all
    sources, ties by source and pass. Texts without words are never served; a null source is a source."""
    names, docs = docs.columns, with_rows(docs)
    mixed = mixing.mix(docs, key="__row", written=lambda df: materialize(df, "sizes"))
    served = mixed.select("__row", "size", F.col("source").alias("__source"), F.explode("packets").alias("__x")).where(2 * F.col("__x.words") >= F.col("size"))
    taken = docs.join(served.drop("size").hint("merge"), "__row")
    return taken.orderBy("__x.finish", "__source", "__x.pass", "__row").select(*names)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces: what a trainer reads, a row for each row of docs; a null text has no pieces."""
    return piece_codec.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), cache=75_000, slice_bytes=1 << 20).select("doc_id", "source", "ids", "n_pieces")


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: Alignment, entropy and piece search aren't SQL; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            unwritten(last)  # its reader is written
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
