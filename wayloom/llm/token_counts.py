"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content next to the SHA-256 of the tokenizer's file. Normalised means: each
run of ASCII white space as one space where the tokenizer's own normaliser does that too, so that counts can't change;
with any other tokenizer the text as it is. Counts already stored
under both are joined; the others are reduced to one text for each key before the shuffle ends, encoded once, and
appended to the cache, a Parquet table. An append that is repeated after a failure stores equal rows, which reading
reduces to one.

Defined results: null text counts as empty (0 bytes, 0 tokens); strings of special tokens within a text are handled as
the library does by default; texts are never cut; repeated rows stay and share one count; an empty table gives an empty
table; rows with null or repeated ids are counted each; no result depends on an order, so there are no ties; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wayloom.llm.common import GAP, pieces_of, text_of

_TOKENIZERS: dict[str, object] = {}


def tokenizer(data: bytes, version: str):
    """One tokenizer for each worker process."""
    if version not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[version] = Tokenizer.from_str(data.decode())
        _TOKENIZERS[version].no_truncation()
        _TOKENIZERS[version].no_padding()
    return _TOKENIZERS[version]


def collapses(data: bytes) -> bool:
    """Whether the tokenizer in a file's bytes turns each run of white space into a space before it looks at it."""
    first = json.loads(data).get("normalizer") or {}
    steps = first.get("normalizers", [first])
    return any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)


def with_digest(docs: DataFrame, collapse: bool) -> DataFrame:
    content = F.regexp_replace("text", GAP, " ") if collapse else F.col("text")
    return text_of(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))


def stored(spark, cache_path: str, version: str) -> DataFrame | None:
    try:
        cache = spark.read.schema("digest binary, tokenizer string, n_tokens long").parquet(cache_path)
    except AnalysisException:
        return None  # no cache yet
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; new counts are appended to the table at cache_path."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    version = hashlib.sha256(data).hexdigest()
    shared = spark.sparkContext.broadcast(data)
    keyed = with_digest(docs, collapses(data))
    misses = keyed.groupBy("digest").agg(F.first("content").alias("text"))
    if (known := stored(spark, cache_path, version)) is not None:
        misses = misses.join(known, "digest", "left_anti")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = tokenizer(shared.value, version)
        for b in (x for whole in batches for x in pieces_of(whole)):
            n = [len(e.ids) for e in t.encode_batch_fast(b.column(1).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    misses.select("digest", "text").mapInArrow(encode, "digest binary, tokenizer string, n_tokens long").write.mode("append").parquet(cache_path)
    counts = stored(spark, cache_path, version)
    return keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
