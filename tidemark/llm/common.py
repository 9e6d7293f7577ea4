"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where all is one machine, one is made if none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files once the query has ended; what it wrote no longer needs them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths written and not yet removed, with the session that wrote them.
_WRITTEN: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them back.

    The table stays until discard(), or sweep() for what a lazy result still reads; the end of the driver sweeps too."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    _WRITTEN[path] = spark
    try:
        df.write.partitionBy(*by or []).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing lazy depends on it."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.pop(path, None)


def sweep(spark: SparkSession | None = None) -> int:
    """Delete all that materialise() has left, once the results have been read or written; how many tables went."""
    paths = [p for p, s in _WRITTEN.items() if spark is None or s is spark]
    for path in paths:
        with contextlib.suppress(Exception):  # a session that has ended takes its gateway with it
            remove(_WRITTEN[path], path)
        _WRITTEN.pop(path, None)
    return len(paths)


atexit.register(sweep)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def id_text_mod(col: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(n))


#: Cells of the hash range that a sample's cut is found in: so many counts, of each stratum, are summed up.
CELL_BITS = 14


def hash_sample(df: DataFrame, keys: list[str], most: int, by: str | None = None) -> DataFrame:
    """The rows of at most ``most`` keys, those with the smallest hash; in each stratum ``by``, if one is named.

    A key counts once however often it repeats, and one of its rows is kept. All rows are counted by cell of the hash
    range first; the cells up to the one that completes the sample hold every row that can be in it, so min(most, the
    number of keys) come back at any size, and the sort after that sees little more than the sample."""
    h = F.xxhash64(*keys)
    cell = F.shiftrightunsigned(F.col("__h"), 64 - CELL_BITS).cast("int").alias("__cell")
    stratum = F.col(by) if by else F.lit(0)
    marked = df.withColumn("__h", h).withColumn("__s", stratum)
    sizes = marked.select("__s", "__h").distinct().groupBy("__s", cell).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__s").orderBy("__cell")) - F.col("__n")
    cuts = sizes.withColumn("__before", upto).where(F.col("__before") < most).groupBy("__s").agg(F.max("__cell").alias("__last"))
    found = {r["__s"]: r["__last"] for r in cuts.collect()}  # a row a stratum
    if not found:
        return df.limit(0)
    if by is None:
        near = marked.where(F.shiftrightunsigned("__h", 64 - CELL_BITS) <= found[0]).dropDuplicates(keys)
        return near.orderBy("__h", *keys).limit(most).drop("__h", "__s")
    last = df.sparkSession.createDataFrame([(k, v) for k, v in found.items()], f"__t {df.schema[by].dataType.simpleString()}, __last int")
    near = marked.join(F.broadcast(last), F.col("__s").eqNullSafe(F.col("__t"))).where(F.shiftrightunsigned("__h", 64 - CELL_BITS) <= F.col("__last"))
    first = F.row_number().over(Window.partitionBy("__s").orderBy("__h", *keys))
    return near.dropDuplicates([by, *keys]).withColumn("__r", first).where(F.col("__r") <= most).drop("__h", "__s", "__t", "__last", "__r")


def by_batch(f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]):
    """A function for mapInArrow out of one that turns a batch into a batch, several, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return run


_BLANK = re.compile(rb"[ \t-\r]")


def parts_of(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of some ``most`` bytes that end where a word ends, so that the words of a long text needn't all be
    held at once."""
    at = 0
    while len(text) - at > most:
        end = _BLANK.search(text, at + most)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def field_of(rows: pa.StructArray, name: str) -> pa.Array:
    """A text column of a column of structs as bytes; null where the struct or the text is."""
    return rows.field(rows.type.get_field_index(name)).cast(pa.binary())


def slices(batch: pa.RecordBatch, col: int | pa.Array, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the bytes in a binary column stay below a bound in each piece (or a piece is one row)."""
    sizes = [0 if x is None else x for x in pa.compute.binary_length(batch.column(col) if isinstance(col, int) else col).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)
