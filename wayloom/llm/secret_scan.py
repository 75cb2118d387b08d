"""Secret scans with corpus-wide ownership frequency.

Each text is searched for candidates of several kinds; every candidate's value is reduced to a digest. The digests'
distinct repositories and owners are counted over the whole corpus: a value that many owners hold is a widely copied
example, a value of one owner that looks random is a live-looking credential. Spans are in code points, end exclusive.

Base kinds (always kept): assign, access, hex. Further kinds: github, jwt, pem.

Defined results: a null text has no spans; long texts are searched whole; a null source counts as an
empty one; equal values in repeated rows of one owner count once; an empty table gives an empty table; rows are told apart by
a key of their own, so rows with a null or repeated doc_id each keep their own spans and verdicts and are masked alike;
overlapping live spans are masked as one; scan() reads only doc_id, text and source, redact()
passes the other columns on (names that begin with __ are its own).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.llm.common import materialize, pieces_of, with_rows
from wayloom.shipping import ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "github", "jwt", "pem")
MORE = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}


def spans_of(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern in MORE.items():
        found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def digest_of(value: str) -> str:
    """What stands for a value outside its document: values themselves aren't shuffled or stored."""
    return hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:32]


def looks_random(value: str, least: float = 2.5) -> bool:
    """Whether the value's characters have an entropy (bits each) of least or more."""
    n = len(value)
    return n > 0 and -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= least


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("digest", T.StringType()), T.StructField("random", T.BooleanType())]))


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs with __row, which tells its rows apart (ids may be null or repeated), unless they have it, and __found, the candidates of each text."""
    ship(docs.sparkSession)
    d = docs if "__row" in docs.columns else docs.withColumn("__row", F.monotonically_increasing_id())
    at, names = d.columns.index("text"), [*d.columns, "__found"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string()), ("random", pa.bool_())]))
        for b in (x for whole in batches for x in pieces_of(whole)):
            found = [[{"kind": k, "start": s, "end": e, "digest": digest_of(v), "random": looks_random(v)} for k, s, e, v in spans_of(t or "")] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=names)

    return d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("__found", SPAN)]))


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, repository and found (its candidates) for each row."""
    d = with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("repository")))
    return d.select(F.col("__row").alias("row"), "doc_id", "repository", F.col("__found").alias("found"))


def ownership(found: DataFrame, owner=None, most_owners: int = 2, most_repositories: int = 8) -> DataFrame:
    """digest, owners, repositories, verdict: example if more than most_owners owners or most_repositories repositories
    hold it, else live if it looks random, else weak. An owner is a repository's name before the first slash."""
    owner = owner if owner is not None else F.substring_index(F.coalesce("repository", F.lit("")), "/", 1)
    held = found.select(F.coalesce("repository", F.lit("")).alias("repository"), owner.alias("owner"), F.explode("found").alias("s")).select(F.col("s.digest").alias("digest"), F.col("s.random").alias("random"), "repository", "owner")
    by_place = held.groupBy("digest", "owner", "repository").agg(F.max("random").alias("random"))
    by_owner = by_place.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.max("random").alias("random"))
    by_digest = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("random").alias("random"))
    example = (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)
    return by_digest.select("digest", "owners", "repositories", F.when(example, "example").when(F.col("random"), "live").otherwise("weak").alias("verdict"))


def secret_verdicts(found: DataFrame) -> DataFrame:
    """row and verdicts, map<digest, verdict> of the candidates, of each row of found (of scan) that has any."""
    every = found.where(F.size("found") > 0).select("row", F.explode("found.digest").alias("digest")).distinct()
    judged = every.join(ownership(found).select("digest", "verdict"), "digest")
    return judged.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("digest", "verdict"))).alias("verdicts"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_weak for each row."""
    found = materialize(scan(docs), "found")
    v = found.join(secret_verdicts(found), "row", "left")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    of = lambda x: F.size(F.filter("found", lambda s: F.try_element_at("verdicts", s["digest"]) == x)).cast("long")
    none = lambda x: F.when(F.col("verdicts").isNull(), F.lit(0).cast("long")).otherwise(of(x))
    return v.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"),
        none("live").alias("n_live"), none("example").alias("n_example"), none("weak").alias("n_weak"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs with the same columns and rows, the text of live-looking candidates replaced by mark, n_chars recounted.

    Rows without candidates, nearly all, pass by; only the others meet the verdicts, by row. Texts are searched again rather
    than kept in a table: that takes less than writing them.
    """
    names, d = docs.columns, with_candidates(with_rows(docs))
    bare = F.size("__found") == 0
    rows = d.where(~bare).select(F.col("__row").alias("row"), F.col("source").cast("string").alias("repository"), F.col("__found").alias("found"))
    live = secret_verdicts(materialize(rows, "candidates")).select(F.col("row").alias("__row"), F.map_keys(F.map_filter("verdicts", lambda _, v: v == "live")).alias("__live"))
    joined = d.where(~bare).join(live, "__row", "left")

    @F.pandas_udf("string")
    def cut(text, live):
        import pandas as pd

        out = []
        for t, digests in zip(text, live, strict=True):
            keep, at = [], 0
            for _, s, e, v in spans_of(t or ""):
                if s >= at and digest_of(v) in set(digests):
                    keep += [t[at:s], mark]
                    at = e
                elif s < at < e and digest_of(v) in set(digests):
                    at = e  # a live span that goes on beyond the one before
            out.append("".join([*keep, t[at:]]) if at else t)
        return pd.Series(out, dtype=object)

    has = F.coalesce(F.size("__live") > 0, F.lit(False))
    some = F.coalesce("__live", F.array().cast("array<string>"))
    masked = F.when(has, cut(F.col("text"), some)).otherwise(F.col("text"))
    changed = joined.withColumn("text", masked)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.where(bare).select(*names).unionByName(changed.select(*names))
