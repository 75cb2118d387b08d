"""The prefix trie of conversations: owners by binary search, owned chains, sums over chains from the bottom up.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it, its owner
the member with the smallest conv_id. Every turn becomes a digest of its content when it is read, so texts are never
shuffled. A prefix's digest is the exclusive or of hashes of (position, turn), two lanes of 64 bits: it can be summed in
any grouping, so a conversation that holds a third of all rows is cut into chunks (ranges of the sorted rows) and each
chunk takes up where the one before ended.

Minima: one row for each prefix digest with the smallest conv_id and the number of members. A conversation that owns a
node owns all its nodes below (fewer members, itself among them), so the first depth that it owns is found by binary
search: all open conversations probe one depth a round, first their own prefixes, then the minima. From there to its end
lies its chain; chains hang on nodes of other chains and form a tree. What subtrees sum (leaves, saved words) is summed
over whole chains first, by doubling (a chain receives from those 1, 2, 4, ... chains below, so rounds grow with the
logarithm of the nesting), then along each chain from its end.

rebuilt() gives conversations that share first turns, as the query asks (with most=1 they are as they came); trie() takes
prefixes of any origin.

Defined results: rows without conv_id belong to no conversation; a null role or text is empty; turns without a number come
first, turns with one number in the order of their digests, repeated rows stay turns of their own; a conversation without
turns is a member of the root alone; an empty table has no nodes, not even a root; texts of any length are read whole;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import dealt, materialize, unwritten, words_of

#: Chains are cut into stretches of so many depths where sums run along them.
STRETCH = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (the turn's digest), words (of its text), chunk; written once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", lane(1).alias("t1"), lane(16).alias("t2"), F.size(words_of(text)).cast("long").alias("words"))
    rows = rows.where("conv_id is not null").withColumn("k", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "t1", "t2", "k"]
    rows = materialize(rows.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), "turns")
    local = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(*order[1:])).cast("long")
    earlier = _earlier(rows, at=(F.count("*"), F.sum))
    out = rows.withColumn("pos", local).join(F.broadcast(earlier), ["conv_id", "chunk"], "left")
    out = materialize(out.select("conv_id", (F.col("pos") + F.coalesce("at", F.lit(0))).alias("pos"), "t1", "t2", "words", "chunk"), "placed")
    unwritten(rows)
    return out


def _earlier(rows: DataFrame, **sums) -> DataFrame:
    """What the earlier chunks of each conversation amount to: conv_id, chunk and the sums, each named with (what is summed within a
    chunk, over chunks). A chunk goes on with one conversation at most, so there are fewer rows than chunks."""
    parts = rows.groupBy("conv_id", "chunk").agg(F.lit(1).alias("one"), *[what.alias(c) for c, (what, _) in sums.items()])
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "chunk", F.sum("one").over(w).alias("before"), *[over(c).over(w).alias(c) for c, (_, over) in sums.items()])
    return parts.where("before > 0").drop("before")


def _item(d) -> list:
    """Two lanes of a turn at a position."""
    return [F.xxhash64(d, F.col("t1"), F.col("t2")).alias("a"), F.xxhash64(F.col("t2"), d, F.col("t1"), F.lit(7)).alias("b")]


def rebuilt(placed: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(prefixes, lengths) of conversations that begin with the first h turns of the first conversation of their group and go on
    with their own turns after h; h = crc32(conv_id) mod most.

    prefixes: conv_id, d (depth, from 0), x, y (digest), words (of the last turn); lengths: conv_id, n."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "t1", "t2", "words")
    shared = first.join(convs.select("conv_id", "base", "h").where("h > 0"), "base").where("d <= h").select("conv_id", "d", "words", *_item(F.col("d")))
    taken = shared.groupBy("conv_id").agg(F.count("*").alias("k"), F.bit_xor("a").alias("ka"), F.bit_xor("b").alias("kb"))
    zero = F.lit(0).cast("long")
    convs = convs.join(taken, "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("k", "ka", "kb")})
    convs = materialize(convs.withColumn("n", F.col("k") + F.greatest(zero, F.col("own") - F.col("h"))), "convs")
    running = lambda c, w: F.bit_xor(c).over(w)
    own = placed.where(F.col("pos") > h).join(convs.select("conv_id", "h", "k", "ka", "kb"), "conv_id")
    own = own.withColumn("d", F.col("k") + F.col("pos") - F.col("h")).select("conv_id", "chunk", "d", "words", "ka", "kb", *_item(F.col("d")))
    own = materialize(own, "own")
    earlier = _earlier(own, ea=(F.bit_xor("a"), F.bit_xor), eb=(F.bit_xor("b"), F.bit_xor))
    w = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"x": running("a", w), "y": running("b", w)})
    own = own.join(F.broadcast(earlier), ["conv_id", "chunk"], "left")
    both = lambda run, base, early: F.col(run).bitwiseXOR(F.col(base)).bitwiseXOR(F.coalesce(early, zero))
    own = own.select("conv_id", "d", both("x", "ka", "ea").alias("x"), both("y", "kb", "eb").alias("y"), "words")
    w = Window.partitionBy("conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # fewer than `most` rows
    shared = shared.select("conv_id", "d", running("a", w).alias("x"), running("b", w).alias("y"), "words")
    root = convs.select("conv_id", zero.alias("d"), zero.alias("x"), zero.alias("y"), zero.alias("words"))
    return own.unionByName(shared).unionByName(root), convs.select("conv_id", "n")


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """With one key for several columns: rows spread over all buckets, those of a long conversation too."""
    return df.withColumn("key", F.xxhash64(*columns))


def _met(asked: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """asked with the row of table, bucketed by its key, that has the same columns. Keys alone are what the join deals by, so that
    the table isn't shuffled; the columns are compared as they meet."""
    b = table.select(F.col("key").alias("__key"), *[F.col(c).alias(f"__{c}") if c in columns else F.col(c) for c in table.columns if c != "key"])
    same = F.col("key") == F.col("__key")
    for c in columns:
        same = same & (F.col(c).bitwiseXOR(F.col(f"__{c}")) == 0)
    return _spread(asked, *columns).join(b, same).drop("key", "__key", *[f"__{c}" for c in columns])


def trie(prefixes: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes have conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; ends has
    for each conversation conv_id, owner and depth of the node where it ends."""
    prefixes = dealt(_spread(prefixes, "conv_id", "d"), "key", "prefixes")
    minima = prefixes.groupBy("d", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    minima = dealt(_spread(minima, "d", "x", "y"), "key", "minima")

    def owners(asked: DataFrame) -> DataFrame:
        """asked (conv_id, d, ...) with the owner of the conversation's prefix of that depth."""
        own = _met(asked, prefixes.drop("words"), "conv_id", "d")
        return _met(own, minima.select("key", "d", "x", "y", "owner"), "d", "x", "y").drop("x", "y")

    longest = lengths.agg(F.max("n")).first()[0]
    search = lengths.select("conv_id", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"))
    for _ in range(0 if longest is None else (longest + 1).bit_length()):  # as many halvings as lengths need
        open_ = search.where("lo < hi").withColumn("d", F.shiftright(F.col("lo") + F.col("hi"), 1))
        mine = F.col("owner") == F.col("conv_id")
        probed = owners(open_).select("conv_id", "n", F.when(mine, F.col("lo")).otherwise(F.col("d") + 1).alias("lo"), F.when(mine, F.col("d")).otherwise(F.col("hi")).alias("hi"))
        last, search = search, materialize(search.where("lo >= hi").unionByName(probed), "search")
        if last.inputFiles() != lengths.inputFiles():
            unwritten(last)
    # chains: from first to n; conversations whose every prefix another one owns have none
    chains = search.where("lo <= n").select("conv_id", F.col("lo").alias("first"), "n")
    hung = owners(chains.where("first > 0").withColumn("d", F.col("first") - 1)).select("conv_id", "first", "n", F.col("owner").alias("parent"))
    chains = materialize(hung.unionByName(chains.where("first = 0").withColumn("parent", F.lit(None).cast("long"))), "chains")
    ends = owners(search.select("conv_id", F.col("n").alias("d"))).select("conv_id", "owner", F.col("d").alias("depth"))
    nodes = minima.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = nodes.join(chains, "conv_id")
    # what a chain holds itself: its saved words, and its end as a leaf unless a chain hangs there
    forks = chains.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("forks"))
    nodes = nodes.join(forks, ["conv_id", "depth"], "left").withColumn("forks", F.coalesce("forks", F.lit(0)).cast("long"))
    leaf = ((F.col("depth") == F.col("n")) & (F.col("forks") == 0)).cast("long")
    nodes = materialize(nodes.withColumn("leaf", leaf), "nodes")
    sums = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.first("parent").alias("up"))
    total = materialize(_subtrees(sums), "totals")
    # along each chain from its end: what hangs on a node counts for it and all above
    hung = chains.where("parent is not null").select("conv_id", F.col("parent"), (F.col("first") - 1).alias("depth")).join(total, "conv_id")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    here = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"leaves": F.col("leaf") + F.coalesce("hung_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("hung_saved", F.lit(0))})
    here = here.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    w = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = here.groupBy("conv_id", "stretch").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    later = later.select("conv_id", "stretch", F.coalesce(F.sum("l").over(below), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("s")).where("l <> 0 or s <> 0")
    out = here.withColumns({"leaves": F.sum("leaves").over(w), "saved": F.sum("saved").over(w)}).join(later, ["conv_id", "stretch"], "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
    children = F.col("forks") + (F.col("depth") < F.col("n")).cast("long")
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
    ), ends


def _subtrees(sums: DataFrame) -> DataFrame:
    """conv_id, leaves, saved of each chain and all below it, from (conv_id, leaves, saved, up): after a round every chain has the
    sums of those fewer than 1, 2, 4, ... chains below and points as many chains up."""
    at = materialize(sums, "sums")
    while not at.where("up is not null").isEmpty():
        from_below = at.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        higher = at.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        both = at.join(from_below, "conv_id", "left").join(higher, "up", "left")
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        last, at = at, materialize(both.select("conv_id", more("leaves", "l"), more("saved", "s"), F.col("next").alias("up")), "sums")
        unwritten(last)
    return at.drop("up")


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of the nodes where conversations end: their conv_ids, ascending, comma-joined.

    The hash of a list runs through it in order, so a node's ids go through one task, as a stream: sorted by Spark, no list is held."""
    parts = max(12, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = ends.select("owner", "depth", "conv_id").repartition(parts, "owner", "depth").sortWithinPartitions("owner", "depth", "conv_id")

    def digest(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        key, h = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([h.hexdigest()])], names=["owner", "depth", "ends_sha256"])

        for b in batches:
            if not b.num_rows:
                continue
            owner, depth, ids = (b.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                text = ",".join(map(str, ids[a:z].tolist())).encode()
                if key == (owner[a], depth[a]):
                    h.update(b"," + text)
                    continue
                if key is not None:
                    yield row()
                key, h = (owner[a], depth[a]), hashlib.sha256(text)
        if key is not None:
            yield row()

    return rows.mapInArrow(digest, "owner long, depth long, ends_sha256 string")


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """nodes with ends_sha256; of nodes where no conversation ends that of an empty string."""
    ended = ends_digests(ends).withColumnRenamed("owner", "conv_id")
    return nodes.join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
