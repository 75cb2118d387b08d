"""Exact top-k search by integer inner products: exhaustive term-at-a-time accumulation over blocks.

A vector's components are terms with integer weights; weights of zero are no entries. Candidates stream through a task in slices;
of each slice the postings of every term are made (rows and weights), and term after term the queries that have it scatter their
weight times the postings into a dense array of scores. The k best of each query are selected by partition, ties and all,
and merged with those of earlier slices, then with those of other tasks.

The queries are a stated set that grows with the table, so they are never broadcast: queries and candidates are dealt into blocks
by row number, and a group of one block of each is a task's work: it holds one block of queries, the running best, and a slice.
No block follows a value of the data, so common vectors can't make one large.

Defined results: vectors that are null or hold null or non-finite components are neither queries nor candidates; a component that
a shorter vector lacks counts as zero, so an empty one and one of zeros score zero; rows with a null vec_id are candidates, last
among ties, but no queries; rows with repeated vec_ids are rows of their own, so a query meets its namesakes but not itself; a
score beyond 64 bits is the nearest 64-bit number; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import materialize

#: Rows of a block of queries, of a slice of candidates, and queries whose scores are accumulated at once.
QUERIES, SLICE, TILE = 4096, 4096, 128
#: Rows of a block of candidates: a share of the table between these, so that small tables use many tasks and large ones merge few results.
SHARE, FEWEST, MOST = 256, 4096, 1 << 20
LAST = 2**63 - 1


def weights(flat: np.ndarray, ends: np.ndarray, scale: float) -> np.ndarray:
    """(rows, terms) of floor(scale * x) as 64-bit integers, or as Python's where a weight needs more."""
    terms = int(ends.max(initial=0))
    x = np.zeros((len(ends), terms))
    x[np.arange(terms) < ends[:, None]] = flat
    with np.errstate(over="ignore"):
        w = np.floor(scale * x)
    if float(np.abs(w).max(initial=0)) < 2**62:
        return w.astype(np.int64)
    return np.array([[math.floor(Fraction(v) * Fraction(scale)) for v in row] for row in x.tolist()], object)


def width(queries: np.ndarray, candidates: np.ndarray):
    """The narrowest type that holds every sum of products."""
    if object in (queries.dtype, candidates.dtype):
        return object
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, candidates.shape[1])
    return np.int32 if reach < 2**31 else np.int64 if reach < 2**63 else object


def scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """(n, queries): term after term, the queries' weights times the postings' are scattered into the array."""
    out = np.zeros((n, len(queries)), queries.dtype)
    for term, (rows, w) in enumerate(postings[: queries.shape[1]]):
        q = queries[:, term]
        asking = np.flatnonzero(q)
        if not len(asking) or not len(rows):
            continue
        if len(rows) == n:  # the term is in every row
            out += w[:, None] * q
        elif len(asking) * 4 < len(q):
            out[np.ix_(rows, asking)] += w[:, None] * q[asking]
        else:
            out[rows] += w[:, None] * q
    return np.clip(out, -LAST - 1, LAST).astype(np.int64) if out.dtype == object else out


def post(candidates: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows that have it and their weights; a term that most rows have is kept for all, zeros among them."""
    out = []
    for term in range(candidates.shape[1]):
        w = np.ascontiguousarray(candidates[:, term])
        rows = np.flatnonzero(w)
        out.append((np.arange(len(w)), w) if 2 * len(rows) >= len(w) else (rows, w[rows]))
    return out


def selected(got: np.ndarray, ids: np.ndarray, keys: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions of the k best of each query by score, id and key, its own row left out; got is (candidates, queries)."""
    s = np.ascontiguousarray(got.T)
    mine = keys[None, :] == own[:, None]
    if s.shape[1] > k + 1:  # k + 1: the query's own row may be among them
        least = np.partition(s, -k - 1, axis=1)[:, -k - 1]
        hit = (s >= least[:, None]) & ~mine
    else:
        hit = ~mine
    q, c = np.nonzero(hit)
    return _best(q, c, s[q, c], ids[c], keys[c], k)


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (query, candidate, score, id, key) the first k of each query."""
    order = np.lexsort((keys, ids, ~s.astype(np.int64), q))  # ~s falls as s rises, without overflow
    q, c = q[order], c[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[place < k], c[place < k]


class Best:
    """The running best of a block of queries: rows (query position, score, id, key)."""

    def __init__(self, queries: np.ndarray, keys: np.ndarray, k: int):
        self.queries, self.keys, self.k = queries, keys, k
        self.q = self.s = self.ids = self.of = None

    def take(self, candidates: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        wide = width(self.queries, candidates)
        postings, new = post(candidates.astype(wide)), []
        for a in range(0, len(self.keys), TILE):
            got = scores(self.queries[a : a + TILE].astype(wide), postings, len(ids))
            q, c = selected(got, ids, keys, self.keys[a : a + TILE], self.k)
            new.append((q + a, got[c, q], ids[c], keys[c]))
        parts = [np.concatenate(x) for x in zip(*new, strict=True)]
        if self.q is not None:
            parts = [np.concatenate(x) for x in zip((self.q, self.s, self.ids, self.of), parts, strict=True)]
        _, at = _best(parts[0], np.arange(len(parts[0])), parts[1], parts[2], parts[3], self.k)
        self.q, self.s, self.ids, self.of = (x[at] for x in parts)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, query_rows: int = QUERIES, candidate_rows: int | None = None, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding) whose id is divisible by `every` the k other rows
    with the highest inner products of floor(scale * x), ties to the smaller vec_id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    if v.schema["e"].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.withColumn("e", F.col("e").cast("array<double>"))
    good = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = materialize(v.where(good).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, m = v.agg(F.count("*"), F.count_if(asks)).first()
    per = candidate_rows or min(max(n // SHARE, FEWEST), MOST)
    query_blocks, blocks = max(1, math.ceil(m / query_rows)), max(1, math.ceil(n / per))
    deal = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = v.where(asks).select(F.lit(0).alias("kind"), deal(query_blocks).alias("qb"), each(blocks).alias("cb"), "row", "vec_id", "e")
    rows = v.select(F.lit(1).alias("kind"), each(query_blocks).alias("qb"), deal(blocks).alias("cb"), "row", "vec_id", "e")
    parts = max(query_blocks * blocks, int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = queries.unionByName(rows).repartition(parts, "qb", "cb").sortWithinPartitions("qb", "cb", "kind")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, asked, best = None, [], None

        def block(b) -> tuple:
            e, ids = b.column(5), b.column(4)
            return weights(e.flatten().to_numpy(), np.asarray(e.value_lengths()), scale), ids.fill_null(LAST).to_numpy(), b.column(3).to_numpy()

        def opened() -> Best:
            terms, wide = max(x[0].shape[1] for x in asked), object if any(x[0].dtype == object for x in asked) else np.int64
            padded = [np.pad(x[0].astype(wide), ((0, 0), (0, terms - x[0].shape[1]))) for x in asked]
            return Best(np.concatenate(padded), np.concatenate([x[2] for x in asked]), k)

        def out() -> Iterator:
            if best is not None and best.q is not None and len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.keys[best.q], best.ids, best.of, best.s.astype(np.int64))], names=["query", "vec_id", "row", "score"])

        for b in (x.slice(a, slice_rows) for x in batches for a in range(0, x.num_rows, slice_rows)):
            kind, q, c = (b.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if at != (q[a], c[a]):
                    yield from out()
                    at, asked, best = (q[a], c[a]), [], None
                part = block(b.slice(a, z - a))
                if kind[a] == 0:
                    asked.append(part)
                elif asked or best is not None:
                    best = best or opened()
                    asked = []
                    best.take(*part)
        yield from out()

    found = materialize(dealt.mapInArrow(search, "query long, vec_id long, row long, score long"), "found")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = v.where(asks).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "score")
