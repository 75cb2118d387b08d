"""GTFS feeds in zip archives, as one table of cells.

An archive is read as a whole (deflated entries can be read only from their start), its entries one after the other as streams:
each is decoded by its own fallback, cut into records with quoted line breaks, and handed on in batches, so no entry is held.
What is written is Parquet by entry: later reads are split, and take the columns and files that they need."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.fixpoint import shared_dir
from wayloom.shipping import ship

CELLS = "archive string, name string, line long, header array<string>, cells array<string>"
#: Records of a batch.
RECORDS = 20_000


def encoding(stream) -> str:
    """UTF-8 (a byte-order mark or not) if all of a stream is, else Latin-1."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while block := stream.read(1 << 20):
            decoder.decode(block)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8-sig"


def records(data: bytes) -> Iterator[tuple[str, int, list[str], list[str]]]:
    """(name, line, header, cells) of the records of all .txt entries of a zip archive, folders within it left out; blank lines don't count."""
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for entry in sorted(x for x in z.namelist() if x.endswith(".txt")):
            with z.open(entry) as f:
                kind = encoding(f)
            name = entry.rpartition("/")[2].removesuffix(".txt")
            with z.open(entry) as f:
                rows = csv.reader(io.TextIOWrapper(f, encoding=kind, newline=""))
                header = [c.strip() for c in next(rows, [])]
                yield name, 0, header, []  # a file without records is still there
                for line, cells in enumerate(rows, 1):
                    if cells:
                        yield name, line, header, cells


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """archive (its path), name (of an entry), line, header, cells of all records of the archives at path (one, or a folder or pattern of them), written."""
    ship(spark)

    def run(batches: Iterator) -> Iterator:
        from itertools import batched

        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for rows in batched(records(data.as_py()), RECORDS):
                    columns = [[at] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CELLS.split(", ")])

    import uuid

    whole = spark.read.format("binaryFile").load(path).select("path", "content")
    out = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"
    whole.mapInArrow(run, CELLS).write.partitionBy("name").parquet(out)
    return spark.read.schema(CELLS).parquet(out)


def member(cells: DataFrame, name: str, columns: list[str]) -> DataFrame | None:
    """A file of an unpacked feed with the named columns as trimmed strings (null where it lacks one or is blank) and __line; None without the file."""
    own = cells.where(F.col("name") == name)
    if own.isEmpty():
        return None
    value = lambda c: F.nullif(F.trim(F.try_element_at("cells", F.nullif(F.array_position("header", F.lit(c)), F.lit(0)).cast("int"))), F.lit(""))
    return own.where("line > 0").select(*[value(c).alias(c) for c in columns], F.col("line").alias("__line"))
