"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

Each source's documents are shuffled by a hash and served whole; a document's virtual finish time is its source's cumulative
words, up to and including it, over the source's target, and goes on into a second pass. All sources are then range-sorted
by virtual finish time and truncated where the total budget is spent: nothing but that cut ends a source, which by then has
been served its target, within a document. The ranges are stretches of virtual time, whose words are summed; the range in
which the budget ends is the only one that must be sorted to find the last document served, and every row then tells by its
own finish time what is taken of it.

Cumulative sums split every source, hot ones too, into buckets by the leading bits of the shuffle hash: a window within
(source, bucket), and offsets from the buckets' sums. The number of buckets grows with the table, so a bucket stays
small; only sums of sources and buckets are ever gathered.

Targets: weights 5, 2, 1, repeating over sources by code point, nulls last; budget times all sizes is shared by weight,
a target stops at most times its source's size, and what is beyond is shared among the others, until none is above.

Defined results: the size of a text is its number of words (null: 0); documents of size 0 take 0; the one document in which
the budget ends takes the words up to it; ties of the hash go by doc_id and size, ties of finish times by source; equal rows
are told apart in any order, which gives the same rows; null or repeated ids stay rows of their own, spread by their texts
(mix names them by a key if there is one); an empty table gives an empty table; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import words_of

WEIGHTS = (5.0, 2.0, 1.0)


HASH_BITS = 60


def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, source, size and h, a hash of id and text that SQL engines share: the first 60 bits of an MD5. Ids may be null or
    repeated, so a key, a column that tells all rows apart, may be carried along."""
    named = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    h = F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.size(words_of(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long").alias("size"), h.alias("h"), *([key] if key else []))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size): water filling over the table of sources.

    Sources sorted by cap over weight reach their caps in that order, so one pass of cumulative sums finds which do."""
    every = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = by_source.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"), (budget * F.sum("source_size").over(every)).alias("total"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(order), F.lit(0.0)), "weight_all": F.sum("weight").over(every)})
    level = (F.col("total") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    s = s.withColumns({"full": F.col("cap") <= level * F.col("weight")})
    s = s.withColumn("level", F.max(F.when(~F.col("full"), level)).over(every))  # of the first that isn't full; later ones assume more caps
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).cast("double").alias("target"))


def queue(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0, bucket_rows: int = 20_000, written=lambda df: df, key: str | None = None) -> DataFrame:
    """doc_id, source, name, size, source_size, target, before (words of its source served before it), and the key if one is named. written may cut lineage."""
    row = [key] if key else []
    d = written(sizes(docs, key))
    bits = max(7, (d.count() // bucket_rows).bit_length())
    name = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))
    d = d.withColumns({"key": name, "bucket": F.shiftright("h", HASH_BITS - bits).cast("int")})
    sums = d.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    by_source = sums.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    goals = targets(by_source, weights, budget, most).withColumn("key", name).drop("source")
    w = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("local", F.coalesce(F.sum("size").over(w), F.lit(0)))
    joined = local.join(offsets.join(goals, "key"), ["key", "bucket"])
    return joined.select("doc_id", "source", F.col("key").alias("name"), "size", "source_size", "target", (F.col("offset") + F.col("local")).alias("before"), *row)


def _served(q: DataFrame, budget: float, bucket_rows: int) -> DataFrame:
    """q with packets: an array of (pass, words, finish) of each time a document is served, truncated at the total budget."""
    packets = []
    for n in (0, 1):
        before = F.col("before") + n * F.col("source_size")
        finish = F.try_divide(before + F.col("size"), "target")
        packets.append(F.struct(F.lit(n).alias("pass"), F.col("size").alias("words"), finish.alias("finish"), before.alias("before")))
    q = q.withColumn("packets", F.filter(F.array(*packets), lambda x: (x["words"] > 0) & x["finish"].isNotNull()))
    every = q.select("name", F.explode("packets").alias("x")).select("name", "x.*")
    # ranges of virtual time, about bucket_rows documents each where the budget ends: their sums show where that is
    size = q.agg(F.greatest(F.lit(16), F.ceil(F.count("*") / bucket_rows)).alias("ranges"), F.round(budget * F.sum("size")).cast("long").alias("most"))
    ranged = every.crossJoin(F.broadcast(size)).withColumn("range", F.least(F.floor(F.col("finish") / (1 + F.col("finish")) * F.col("ranges")), F.col("ranges") - 1))
    sums = ranged.groupBy("range", "most").agg(F.sum("words").alias("words"))
    so_far = Window.partitionBy("most").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = sums.withColumn("spent", F.coalesce(F.sum("words").over(so_far), F.lit(0))).where("spent <= most and spent + words > most").select("range", "spent")  # one range at most
    order = Window.partitionBy("range").orderBy("finish", "name", "before").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.join(F.broadcast(last), "range").withColumn("spent", F.col("spent") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    cut = within.where("spent <= most and spent + words > most").agg(F.max(F.struct("finish", "name", "before")).alias("cut"), F.max(F.col("most") - F.col("spent")).alias("left"))  # one row
    q = q.crossJoin(F.broadcast(cut))
    place = lambda x: F.struct(x["finish"].alias("finish"), F.col("name"), x["before"].alias("before"))
    words = lambda x: F.when(F.col("cut").isNull() | (place(x) < F.col("cut")), x["words"]).when(place(x) == F.col("cut"), F.col("left")).otherwise(F.lit(0).cast("long"))
    kept = F.transform("packets", lambda x: F.struct(x["pass"].alias("pass"), words(x).alias("words"), x["finish"].alias("finish")))
    return q.withColumn("packets", F.filter(kept, lambda x: x["words"] > 0)).drop("cut", "left")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0, bucket_rows: int = 20_000, written=lambda df: df, key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, packets (pass, words, finish of each time it is served) for each row of docs, and the key if one is named."""
    q = written(queue(docs, weights, budget, most, bucket_rows, written, key))
    taken = F.aggregate("packets", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return _served(q, budget, bucket_rows).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "packets", *([key] if key else []))


def mixed_order(docs: DataFrame, **kw) -> DataFrame:
    """A row for each served copy: doc_id, source, pass (0, 1), words (those taken), virtual_finish; globally range-sorted."""
    key = [kw["key"]] if kw.get("key") else []
    copies = mix(docs, **kw).select("doc_id", "source", *key, F.explode("packets").alias("x"))
    return copies.select("doc_id", "source", *key, "x.pass", "x.words", F.col("x.finish").alias("virtual_finish")).orderBy("virtual_finish", "source", "doc_id", "pass")
