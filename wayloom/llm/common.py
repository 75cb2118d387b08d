"""What several operators need: shared tables that cut lineage, reading inputs, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.fixpoint import shared_dir, written
from wayloom.shipping import ship

#: A word is a run of characters other than these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def shuffles_end(spark: SparkSession):
    """Shuffle files go as soon as the job that wrote them is done: what it made is a table by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


#: Rows of a batch between Spark and Python where rows carry texts or sequences.
BATCH = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run within hand BATCH rows at once to Python workers: the whole of a task's texts is never held, in the JVM or in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later jobs survive lost executors and don't recompute it."""
    ship(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return written(df, name)


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written as a table bucketed by key: joins on it don't shuffle its rows, texts among them, again."""
    spark = df.sparkSession
    ship(spark)
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex[:12]}"
    with shuffles_end(spark):
        df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name; the files stay, and out knows them
    return out


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with __row, a key of its own for each row: the number of its file and its place there, so that every scan gives the
    same keys and no copy of the texts is needed. What doesn't come straight from files is written first.

    The list of files is broadcast: the driver holds it anyway to plan a scan."""
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select("*", place["file_path"].alias("__file"), place["row_index"].alias("__at"))
    except AnalysisException:
        return with_rows(materialize(docs, "rows"))
    files = sorted(r[0] for r in rows.select("__file").distinct().collect())
    known = docs.sparkSession.createDataFrame(list(enumerate(files)), "__number long, __file string")
    key = F.shiftleft("__number", 40) + F.col("__at")
    return rows.join(F.broadcast(known), "__file").select(*docs.columns, key.alias("__row"))


def unwritten(*tables: DataFrame) -> None:
    """Remove the files of written tables that nothing reads any more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_of(df: DataFrame) -> DataFrame:
    """The documents' id and text alone, null texts as empty ones; other columns can't clash with an operator's own."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words_of(text):
    """Column: the array of words of a text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of the graph with undirected edges (a, b); component is the smallest reachable node.

    Alternates large-star and small-star contraction, each a groupBy with partial minima, and writes each round's
    edges to the shared folder. Rounds grow with the logarithm of the largest component; the loop ends when a round
    changes nothing. Hubs don't concentrate rows: a node's neighbours are never gathered in one task, only their
    minimum is, and the join back on a hub is one that adaptive execution can split.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        # small star: every smaller neighbour of a node, and the node, link to its smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialize(small, "edges")
        changed = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError("connected components didn't converge")
    # at the fixed point every edge leads from a node to its component's smallest node
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()


def pieces_of(batch, column: str = "text", max_bytes: int = 2 << 20):
    """Slices of an Arrow batch whose texts take about max_bytes together (one row at least), so that a worker's Python objects stay few."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + max_bytes, side="right")))
        yield batch.slice(a, b - a)
        a = b


def packed(batches):
    """mapInArrow: (doc_id, text) to (doc_id, z), the text as UTF-8 compressed before it is shuffled."""
    import pyarrow as pa
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    for b in (x for whole in batches for x in pieces_of(whole)):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(t) for t in texts], pa.binary())], names=["doc_id", "z"])


def unpacked(z: list[bytes]) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in z]
