"""How kernels run: one Arrow crossing per plan, all outputs from one parse.

Every operator is a map over documents, so a plan adds no shuffle of its own and works on streams
too. Callers' filters belong before the kernel, where Catalyst can push them to the scan. A table whose
rows lie in few row groups keeps as many cores busy, however often its file is split: spread() first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch: documents can be large.
BATCH_ROWS = 256
#: Bytes of a table's files that are worth a task of their own.
TASK_BYTES = 16384

Rows = Callable[[str], list[dict] | list[tuple]]


def kernel(df: DataFrame, rows: Rows, schema: T.StructType, source: str = "source", on_error: str = "raise") -> DataFrame:
    """For each row of df, the rows that `rows` makes of its source (dicts, or tuples in the order of the
    schema), beside the row's other columns.
    A null source counts as empty. on_error: "raise", or "null" to skip documents that fail."""
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be 'raise' or 'null', got {on_error!r}")
    names = [c for c in df.columns if c != source]
    clash = set(names) & set(schema.names)
    if clash:
        raise ValueError(f"columns clash with the output: {sorted(clash)}")
    out = T.StructType([df.schema[c] for c in names] + schema.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                take, made = [], []
                for i, text in enumerate(part.column(source).to_pylist()):
                    try:
                        found = rows(text or "")
                    except Exception:
                        if on_error == "raise":
                            raise
                        continue
                    take += [i] * len(found)
                    made += found
                index = pa.array(take, pa.int64())
                columns = [part.column(c).take(index) for c in names]
                if made and isinstance(made[0], tuple):
                    columns += [pa.array(c, f.type) for f, c in zip(arrow, zip(*made))]
                else:
                    columns += [pa.array([m[f.name] for m in made], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *schema.names])

    return df.mapInArrow(run, out)


def spread(df: DataFrame) -> DataFrame:
    """A table's rows dealt evenly, for a Python kernel after it: one task for each TASK_BYTES, up to
    four for each core or spark.sql.shuffle.partitions, whichever is more. What has a file for each of
    these, or is worth one task only, stays as it is."""
    spark = df.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    tasks = min(-(-size // TASK_BYTES), most)
    return df if tasks <= 1 or len(df.inputFiles()) >= tasks else df.repartition(tasks)


def struct(text: str) -> T.StructType:
    """A schema from DDL."""
    return T.StructType.fromDDL(text)
