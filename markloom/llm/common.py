"""What the corpus operators share: the shared work folder, stored tables, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch brings to Python. Documents reach megabytes, so batches stay short.
BATCH_ROWS = 256

#: The most keys that met() broadcasts.
HOT = 1000


def session_of(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    (tests on one machine), a temporary folder that is then set for the session. A cluster without
    the setting raises ValueError: its executors share no folder that could be made up here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="markloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/markloom/{label}-{uuid.uuid4().hex}"


#: The folders that stored() wrote within each open scratch().
_scratch: list[list[str]] = []


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends at files that
    outlive any executor. Inside scratch() they go at its end; those to be kept, at the end of the
    scratch() around that one, if there is one."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    if holders := _scratch[:-1] if keep else _scratch:
        holders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() wrote inside: for tables that only others read which are
    stored by then and kept."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        for path in paths:
            removed(spark, path)
        give_back()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a work folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_prefix(columns: Iterable[str]) -> str:
    """Underscores that no column's name begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def met(left: DataFrame, right: DataFrame, keys: list[str], total: int | None = None, flag: str | None = None) -> DataFrame:
    """left joined with right on keys that are unique in right. right's column `copies` says how many
    rows of left have each key, `total` (counted if not given) how many that makes; `copies` does not
    go on. The keys of a thousandth of all those rows or more, at most HOT of them, are broadcast, so
    no task gathers the rows of a very common key. With a `flag` all rows of left stay, and the column
    of that name says whether right has their key."""
    if total is None:
        total = right.agg(F.sum("copies")).first()[0] or 0
    hot, cold = (right.where(f"copies * {HOT}L {sign} {total}L").drop("copies") for sign in (">=", "<"))
    if flag:
        hot, cold = (x.withColumn(flag, F.lit(True)) for x in (hot, cold))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left" if flag else "inner")
    if flag:
        rest = rest.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The column's values as UTF-8, without a detour over str."""
    at = batch.column(name)
    return at.cast(pa.large_binary() if pa.types.is_large_string(at.type) else pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def in_chunks(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each piece hold about `most` bytes at most; a longer
    single text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [len(x or b"") for x in byte_column(batch, column)]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of a partition what it freed goes back to the system: a worker lives for
    many stages, and what it keeps adds to theirs."""

    @wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return through


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def gathered(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Joins batches, and cuts them, so that the texts of each piece hold about `most` bytes; a
    longer single text comes alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for piece in in_chunks(batches, column, most):
        own = piece.column(column).nbytes
        if held and size + own > most:
            yield joined()
            held, size = [], 0
        held.append(piece)
        size += own
    if held:
        yield joined()


def jvm_collected(spark: SparkSession) -> None:
    """The driver's JVM collects its garbage and gives back heap. For loops of many small jobs: their
    plans and generated code are garbage soon, but the heap would rather grow to its limit first."""
    spark._jvm.System.gc()


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator needs, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
