"""Near-duplicates by Order MinHash.

A document's shingles are its windows of five words, each labelled with its occurrence (first, second, ...). Each of
SKETCHES sketches takes the MINIMA labelled shingles with the smallest hashes and keeps them in text order; equal
sketches make candidates. Since order is part of a sketch, texts with the same shingles in another order rarely meet.

Candidates are verified by a banded alignment: labelled shingles match in the same order within a band as wide as a
similarity of 0.8 allows, and a word is matched if a matched shingle covers it. A pair links if the matched words are 0.8
of the longer text or more. One changed word costs five shingles but one word, so this follows edits, not shingles lost.

Documents with equal words form one class first. All pairs of classes that share a sketch are compared: those of buckets of
up to SMALL classes as a table of pairs; larger buckets are cut into blocks, and each pair of blocks is compared in a
group of its own, one sequence with a block at once. A pair counts once, whatever the number of buckets it shares.

Defined results: a text of one to four words is one shingle; a text without words (null too) links with nothing and is
its own class; long texts are compared whole; rows are documents of their own even if their doc_id is null or repeated, and
a class is named by its smallest doc_id (null if all are null); an empty table gives an empty table; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import connected_components, materialize, packed, pieces_of, small_batches, text_of, unpacked, unwritten

SHINGLE, SIMILARITY = 5, 0.8
MINIMA, SKETCHES, SMALL = 3, 24, 8
BLOCK, BLOCK_SHINGLES, SLICE_BYTES = 512, 1 << 20, 2 << 20
M1, M2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x5851F42D4C957F2D
SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCHES, dtype=np.int64).astype(np.uint64)
_POWERS: list[np.ndarray] = []
#: Powers that a worker keeps between slices; longer tables are made for a long text and go with it.
KEPT = 3 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if _POWERS and len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    both = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    if n <= KEPT:
        _POWERS[:] = both
    return both[0], both[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit hashes, and where each text's words begin (one more entry than texts)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    up, down = powers(len(raw) + 1)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a gap
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def labelled(words: np.ndarray) -> np.ndarray:
    """A text's shingles in order, hashed with their occurrence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < SHINGLE:
        s = np.array([0], np.uint64)
        for w in words:
            s = mix(s * np.uint64(BASE) + w)
    else:
        s = np.zeros(n - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            s = s * np.uint64(BASE) + words[i : n - SHINGLE + 1 + i]
        s = mix(s)
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    if not new.all():
        at = np.arange(len(s))
        label = np.empty(len(s), np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        s = np.where(label > 0, mix(s + label * M1), s)
    return s


def sketches(s: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the MINIMA smallest labelled shingles in text order."""
    h = mix(s[None, :] ^ SEEDS[:, None])
    if len(s) > MINIMA:
        at = np.sort(np.argpartition(h, MINIMA - 1, axis=1)[:, :MINIMA], axis=1)
    else:
        at = np.tile(np.arange(len(s)), (SKETCHES, 1))
    out = SEEDS.copy()
    for k in range(at.shape[1]):
        out = mix(out * np.uint64(BASE) + s[at[:, k]])
    return out


def covered(at: np.ndarray) -> int:
    """Words that shingles at increasing places cover."""
    return int(np.minimum(np.diff(at), SHINGLE).sum()) + SHINGLE if len(at) else 0


def _in_order(j: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing run of j."""
    tails, last, before = [], [], np.full(len(j), -1)
    for i, x in enumerate(j.tolist()):
        k = bisect_left(tails, x)
        tails[k : k + 1], last[k : k + 1] = [x], [i]
        before[i] = last[k - 1] if k else -1
    run = [last[-1]]
    while before[run[-1]] >= 0:
        run.append(int(before[run[-1]]))
    return np.array(run[::-1])


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Matched words over those of the longer text, for sequences of distinct labelled shingles; 0 where it is surely below similarity."""
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):  # the same run decides whichever comes first
        a, b = b, a
    longer = len(b) + SHINGLE - 1
    need = similarity * longer
    if not len(a) or len(a) + SHINGLE - 1 < need - 1e-9:
        return 0.0
    band = int(longer - need + 1e-9)  # as many words at most are unmatched
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    j = order[at]
    i = np.flatnonzero((b[j] == a) & (np.abs(j - np.arange(len(a))) <= band))
    j = j[i]
    if min(covered(i), covered(np.sort(j))) < need - 1e-9:
        return 0.0
    if (np.diff(j) < 0).any():
        run = _in_order(j)
        i, j = i[run], j[run]
    return min(covered(i), covered(j)) / longer


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the words; null without any), sketches, n (shingles)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (x for whole in batches for x in pieces_of(whole, max_bytes=1 << 20)):
            hashes, begins = word_hashes([t.encode() for t in b.column(1).to_pylist()])
            digest, keys, sizes, counts = [], [], [], []
            for x, y in zip(begins.tolist(), begins.tolist()[1:], strict=False):
                w = hashes[x:y]
                if len(w):
                    keys.append(sketches(labelled(w)).view(np.int64))
                    place = np.arange(1, len(w) + 1, dtype=np.uint64) * M1
                    digest.append(mix(w + place).sum(dtype=np.uint64).tobytes() + mix(w ^ mix(place)).sum(dtype=np.uint64).tobytes())
                else:
                    digest.append(None)
                sizes.append(SKETCHES if len(w) else 0)
                counts.append(max(len(w) - SHINGLE + 1, min(len(w), 1)))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), lists, pa.array(counts, pa.int64())], names=["doc_id", "digest", "sketches", "n"])

    return docs.mapInArrow(run, "doc_id long, digest binary, sketches array<long>, n long")


def _candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of buckets of up to SMALL, rows (id, own) of larger ones) from (k, key, id, n); own lists the id's large buckets as (k, key, blocks)."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).where("n > 1")
    shared = rows.drop("n").join(sizes, "key")
    ids = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # SMALL at most
    each = ids.select(F.explode(F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    large = shared.where(F.col("n") > SMALL).groupBy("id").agg(F.collect_list(F.struct("k", "key", blocks.alias("blocks"))).alias("own"))  # SKETCHES at most
    return each.distinct(), large


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, z): the compressed text of each of the ids (doc_id), once."""
    # a merge join at every size: the list of documents grows with the corpus, so its plan shouldn't turn on a size estimate
    texts = docs.mapInArrow(packed, "doc_id long, z binary").join(ids.distinct().hint("merge"), "doc_id", "left_semi")
    return materialize(texts.groupBy("doc_id").agg(F.first("z").alias("z")), "texts")


def _sequences(texts: list[bytes]) -> list[np.ndarray]:
    hashes, begins = word_hashes(texts)
    return [labelled(hashes[x:y]) for x, y in zip(begins.tolist(), begins.tolist()[1:], strict=False)]


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents align, written."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def shorten(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out() -> pa.RecordBatch:
            s = [x.tobytes() for x in _sequences(texts)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.binary())], names=["doc_id", "s"])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts += unpacked([z])
                size += len(texts[-1])
                if size > SLICE_BYTES:  # texts of any length: as many at once as take SLICE_BYTES
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    seqs = materialize(texts.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(shorten, "doc_id long, s binary"), "shingles")
    both = pairs.join(seqs.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(seqs.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")

    def align(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keep = [alignment(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= SIMILARITY - 1e-9 for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(both.select("a", "b", "sa", "sb").mapInArrow(align, "a long, b long"), "links")
    unwritten(seqs)
    return links


def aligned(s: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of the matrix wanted whose sequences align: alignment() of one sequence with many at once."""
    size = np.array([len(x) for x in s])
    ends = np.cumsum(size)
    _, flat = np.unique(np.concatenate(s), return_inverse=True)
    place = np.full(flat.max() + 1, -1, np.int64)
    own = [flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    out_i, out_j = [], []
    for i in np.flatnonzero(wanted.any(1)).tolist():
        js = np.flatnonzero(wanted[i])
        longer = np.maximum(size[i], size[js]) + SHINGLE - 1
        need = SIMILARITY * longer
        fits = np.minimum(size[i], size[js]) + SHINGLE - 1 >= need - 1e-9
        js, longer, need = js[fits], longer[fits], need[fits]
        if not len(js):
            continue
        place[own[i]] = np.arange(size[i])
        n = size[js]
        first = np.cumsum(n) - n
        at = place[np.concatenate([own[j] for j in js.tolist()])]
        place[own[i]] = -1
        doc = np.repeat(np.arange(len(js)), n)
        here = np.arange(len(at)) - first[doc]
        ok = (at >= 0) & (np.abs(at - here) <= (longer - need + 1e-9).astype(np.int64)[doc])
        at, here, doc = at[ok], here[ok], doc[ok]
        same = doc[1:] == doc[:-1]
        words = [np.bincount(doc, np.append(np.where(same, np.minimum(np.diff(x), SHINGLE), SHINGLE), SHINGLE)[: len(doc)], len(js)) for x in (here, at)]
        back = np.unique(doc[1:][same & (np.diff(at) < 0)])  # matches out of order: the longest run decides
        link = np.minimum(*words) >= need - 1e-9
        link[back] = words[0][back] >= need[back] - 1e-9
        for x in back[link[back]].tolist():
            link[x] = alignment(s[i], s[js[x]]) >= SIMILARITY - 1e-9
        out_i.append(np.full(int(link.sum()), i))
        out_j.append(js[link])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _crowded(large: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, links, low) of ids in large buckets: how many of a block pair's ids it links with, and the smallest reached.

    A bucket is cut into blocks, each pair of blocks a group of its own. A pair counts in its first large bucket, and
    only if no small bucket holds it: small buckets verify their pairs themselves."""
    rows = large.join(classes.select("id", "sketches").hint("merge"), "id").join(texts.select(F.col("doc_id").alias("id"), "z").hint("merge"), "id")
    rows = rows.withColumn("mask", F.aggregate("own", F.lit(0), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["k"])))).withColumn("own", F.explode("own"))
    rows = rows.select("id", "z", "sketches", "mask", "own.*").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["k", "key", "x", "y"]
    dealt = rows.select("k", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "mask", "sketches", "z")
    width = max(12, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(group: list) -> Iterator:
            b = pa.Table.from_batches(group).combine_chunks().to_batches()[0] if len(group) > 1 else group[0]
            n = b.num_rows
            if n < 2:
                return
            k, x, y = (b.column(c)[0].as_py() for c in (0, 2, 3))
            block, ids, mask = (b.column(c).to_numpy() for c in (4, 5, 6))
            keys = b.column(7).flatten().to_numpy().reshape(n, SKETCHES)
            wanted = (block[:, None] == x) & (block[None, :] == y) if x != y else np.triu(np.ones((n, n), bool), 1)
            for other in range(SKETCHES):  # pairs of another bucket
                if other != k:
                    mine = (mask >> other & 1 == 0) if other > k else np.ones(n, bool)
                    wanted &= ~((keys[:, other][:, None] == keys[:, other][None, :]) & mine[:, None])
            if not wanted.any():
                return
            i, j = aligned(_sequences(unpacked(b.column(8).to_pylist())), wanted)
            low = ids.copy()
            while len(i):
                was = low.copy()
                np.minimum.at(low, i, low[j])
                np.minimum.at(low, j, low[i])
                if (was == low).all():
                    break
            links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(low[at])], names=["id", "links", "low"])

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                part = b.slice(a, z - a)
                if held and [held[0].column(c)[0].as_py() for c in range(4)] != [part.column(c)[0].as_py() for c in range(4)]:
                    yield from out(held)
                    held = []
                held.append(part)
        if held:
            yield from out(held)

    return dealt.repartition(width, *key).sortWithinPartitions(*key).mapInArrow(compare, "id long, links long, low long")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), kept, n_links (verified links of its class to others) for each row of docs."""
    t = text_of(docs)
    with small_batches(t.sparkSession):
        sketched = materialize(sketch_table(t), "sketches")
    odd = sketched.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return _classes(t, sketched)
    # ids that don't tell rows apart: rows do, and the smallest id of a class names it
    rows = materialize(t.withColumn("row", F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col("row").alias("doc_id"), "text")
    judged = _classes(own, materialize(sketch_table(own), "sketches")).select(F.col("doc_id").alias("row"), F.col("class_id").alias("class"), "n_links")
    judged = materialize(judged.join(rows.select("row", "doc_id"), "row"), "judged")
    out = judged.join(judged.groupBy("class").agg(F.min("doc_id").alias("class_id")), "class").select("doc_id", "class_id", "n_links")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _classes(t: DataFrame, sketched: DataFrame) -> DataFrame:
    """near_classes of documents (doc_id, text) whose ids are all different, with their sketch_table."""
    with small_batches(t.sparkSession):
        return _judged(t, sketched)


def _judged(t: DataFrame, sketched: DataFrame) -> DataFrame:
    classes = sketched.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min_by("sketches", "doc_id").alias("sketches"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    sketch = classes.select("id", "n", F.posexplode("sketches").alias("k", "h"))
    pairs, large = _candidates(sketch.select("k", F.xxhash64("k", "h").alias("key"), "id", "n"))
    pairs, large = materialize(pairs, "pairs"), materialize(large, "large")
    texts = _texts(t, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select(F.col("id").alias("doc_id"))))
    links = _verify(pairs, texts)
    crowded = materialize(_crowded(large, classes, texts), "crowded")
    unwritten(pairs, large, texts)
    roots = connected_components(links.unionByName(crowded.select(F.col("id").alias("a"), F.col("low").alias("b"))))
    degree = links.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("links")).unionByName(crowded.select("id", "links")).groupBy("id").agg(F.sum("links").alias("n_links"))
    of = classes.select("digest", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    of = of.select("digest", F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sketched.select("doc_id", "digest").join(of, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))), "near")
    unwritten(sketched, classes)
    return out
