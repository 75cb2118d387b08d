"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors are first reduced to one with a count. Each table hashes a vector to the signs of its products with some
hyperplanes; vectors are compared by cosine in double precision where they share a table's bucket. A pair that shares
several buckets counts in the first such table alone, which both rows can tell, so pairs are never listed or shuffled.
Rows carry one vector as it came (floats stay floats); signatures are computed again where they are compared. A bucket is
expected to hold FILL vectors, many more than the fewest that would do, since fewer hyperplanes need fewer tables: products
in a task cost less than vectors on the wire. A bucket over BLOCK is cut into blocks and every pair of blocks is compared
in a group of its own, so neither a common vector nor a dense region gathers in one task; products are taken in tiles. A
group returns, for each vector, the number of links and its smallest relative.

The number of hyperplanes grows with the table's logarithm, and the number of tables with it so that a pair at the
threshold is found with the probability `recall`.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept;
vectors of different lengths don't link; rows with a null or repeated vec_id count as one vector each and get one row
each, a component is named by its smallest vec_id that isn't null; a cosine equal to the threshold links; an empty table
gives an empty table; other columns (labels too) are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import connected_components, materialize, unwritten

FILL, BLOCK, TILE = 768, 8192, 512


def plan(n: int, cosine: float, recall: float, fill: int = FILL) -> tuple[int, int]:
    """(hyperplanes of a table, tables): buckets of about fill vectors of a table of n without structure."""
    bits = min(40, max(4, math.ceil(math.log2(max(n, 2) / fill))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(vectors, tables) of int64."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    return ((vectors @ planes > 0).reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)


def _links(ids: np.ndarray, size: np.ndarray, block: np.ndarray, sigs: np.ndarray, unit: np.ndarray, table: int, cross: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of a group: links (copies counted) that no earlier table shows, and the smallest id it reaches within the group."""
    n = len(ids)
    links, low, changed, counted = np.zeros(n, np.int64), ids.copy(), True, False
    while changed:
        changed = False
        for a in range(0, n, TILE):
            z = min(n, a + TILE)
            near = unit[a:z] @ unit.T >= cosine
            near[np.arange(z - a), np.arange(a, z)] = False
            if cross:
                near &= block[a:z, None] != block[None, :]
            if not near.any():
                continue
            least = np.minimum(low[a:z], np.where(near, low[None, :], np.iinfo(np.int64).max).min(1))
            changed |= bool((least != low[a:z]).any())
            low[a:z] = least
            if not counted:
                for t in range(table):
                    near &= sigs[a:z, t, None] != sigs[None, :, t]
                links[a:z] = near @ size
        counted = True
    return links, low


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, block: int = BLOCK, seed: int = 11, fill: int = FILL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    if v.schema["e"].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.withColumn("e", F.col("e").cast("array<double>"))
    good = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    v = materialize(v.select("vec_id", F.when(good, F.col("e")).alias("e")), "vectors")
    copies = v.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("key"), F.count("*").alias("copies"))
    # id numbers the different vectors in the order of their smallest vec_id, nulls last: vec_ids may be null or repeated
    order = [F.coalesce("key", F.lit(2**63 - 1)), F.xxhash64("e")]
    copies = materialize(copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "copies")
    bits, tables = plan(copies.count(), cosine, recall, fill)

    def units(flat: np.ndarray, dim: int) -> np.ndarray:
        x = flat.reshape(-1, dim).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def hashed(batches: Iterator) -> Iterator:
        """(e, id, copies) to (id, dim, sigs): a bucket for each table."""
        import pyarrow as pa

        for b in (x.slice(a, 2000) for x in batches for a in range(0, x.num_rows, 2000)):
            flat, ends = b.column(0).flatten().to_numpy(), np.asarray(b.column(0).value_lengths())
            starts = np.concatenate([[0], np.cumsum(ends)])
            for dim in np.unique(ends).tolist():
                at = np.flatnonzero(ends == dim)
                sig = signatures(units(flat[(starts[at][:, None] + np.arange(dim)).ravel()], dim), bits, tables, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, tables), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), lists], names=["id", "dim", "sigs"])

    sketched = materialize(copies.select("e", "id", "copies").mapInArrow(hashed, "id long, dim int, sigs array<long>"), "sketched")
    places = sketched.select("id", "dim", F.posexplode("sigs").alias("t", "bucket"))
    # buckets of one vector have no pairs; large ones are cut into blocks, each pair of blocks a group of its own
    big = places.groupBy("t", "bucket", "dim").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).drop("rows")
    dealt = places.join(big, ["t", "bucket", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a vector's places are listed beside it first: vectors are read once and leave only for the groups that compare them
    place = F.struct("t", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")
    lists = dealt.groupBy("id").agg(F.collect_list(place).alias("places"))
    rows = copies.join(lists.hint("merge"), "id").select("id", "copies", "e", F.size("e").alias("dim"), F.explode("places").alias("p"))
    dealt = rows.select("p.t", "p.bucket", "dim", "p.x", "p.y", "p.block", "id", "copies", "e")
    key = ["t", "bucket", "dim", "x", "y"]
    width = max(12, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(group: list) -> Iterator:
            b = pa.Table.from_batches(group).combine_chunks().to_batches()[0] if len(group) > 1 else group[0]
            n, ids = b.num_rows, b.column(6).to_numpy()
            if n < 2:
                return
            t, dim, x, y = (b.column(k)[0].as_py() for k in (0, 2, 3, 4))
            unit = units(b.column(8).flatten().to_numpy(), dim)
            sigs = signatures(unit, bits, tables, seed)
            links, low = _links(ids, b.column(7).to_numpy(), b.column(5).to_numpy(), sigs, unit, t, x != y, cosine)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(low[at])], names=["id", "links", "low"])

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(5)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                part = b.slice(a, z - a)
                if held and [held[0].column(k)[0].as_py() for k in range(5)] != [part.column(k)[0].as_py() for k in range(5)]:
                    yield from out(held)
                    held = []
                held.append(part)
        if held:
            yield from out(held)

    found = materialize(dealt.repartition(width, *key).sortWithinPartitions(*key).mapInArrow(compare, "id long, links long, low long"), "links")
    unwritten(sketched)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    roots = roots.join(copies.select(F.col("id").alias("component"), F.col("key").alias("root")), "component").select(F.col("node").alias("id"), "root", F.lit(True).alias("rooted"))
    classes = copies.join(links, "id", "left").join(roots, "id", "left")
    classes = classes.select("e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("rooted"), F.col("root")).otherwise(F.col("key")).alias("component_id"))
    out = v.join(classes, "e", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
