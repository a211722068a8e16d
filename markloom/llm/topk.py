"""Exact top-k by inner product with a three-phase uniform threshold (operator 1).

The components of the vectors are dealt to LISTS lists; a vector's score is the sum of its partial
scores over the lists. Vectors are kept in blocks, queries too, and every query block meets every
vector block once.

1. In one of every SPARSE blocks the k largest partial scores of each query and list name objects,
   whose whole scores are resolved. The k-th largest of these is a lower bound t of the answer.
2. t goes to all blocks with its query. A vector whose partial scores all lie under the uniform
   threshold t / LISTS scores under t, so only the entries at or above it are collected.
3. What the collected vectors lack of their other partial scores is resolved, and scores of at
   least t are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of, stored

LISTS = 4
#: Rows of a block of vectors, and of queries.
BLOCK, QUERY_BLOCK = 8192, 512
#: Blocks for each one that the lower bound is taken from. The bound is safe whichever these are.
SPARSE = 16
#: Scores under this are exact in doubles.
EXACT = float(1 << 53)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of every component x as a double. Rows whose vector is null or
    holds a null or a non-finite component take no part, nor do rows without a vec_id."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(256 * x) < 2.0**63, F.floor(256 * x)).otherwise(F.raise_error(F.lit("a component does not fit a long")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", whole).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, ids, values, width: up to `size` vectors as one binary value. Shorter vectors are
    filled with zeros, which add nothing to an inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int]]] = []
        count = 0

        def block() -> pa.RecordBatch:
            width = max(1, *(len(v) for _, v in held))
            values = np.zeros((len(held), width), np.int64)
            for i, (_, v) in enumerate(held):
                values[i, : len(v)] = v
            small = values.astype(np.int16)
            values = small if (small == values).all() else values
            name = (TaskContext.get().partitionId() << 32) + count
            return pa.RecordBatch.from_pydict({"block": [name], "ids": [np.array([i for i, _ in held], np.int64).tobytes()], "values": [values.tobytes()], "width": pa.array([width], pa.int32())})

        for batch in batches:
            for row in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.append(row)
                if len(held) == size:
                    yield block()
                    held.clear()
                    count += 1
        if held:
            yield block()

    return rows.mapInArrow(run, "block long, ids binary, values binary, width int")


def matrix(ids: bytes, values: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(values) == 2 * width * len(names) else np.int64
    return names, np.frombuffer(values, kind).reshape(len(names), width)


def partial_scores(data: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """For each list the scores vectors x queries, whole numbers without rounding. ValueError where a
    score does not fit a long."""
    width = max(data.shape[1], queries.shape[1])
    data, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (data, queries))
    largest = float(np.abs(data.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * width
    kind = float if largest < EXACT else np.int64 if largest < 2.0**62 else object
    parts = np.array_split(np.arange(width), min(LISTS, width))
    if kind is object:
        exact = [data[:, p].astype(object) @ queries[:, p].astype(object).T for p in parts]
        if any(abs(x) >= 1 << 63 for m in (*exact, sum(exact)) for x in m.ravel().tolist()):
            raise ValueError("a score does not fit a long")
        return [x.astype(np.int64) for x in exact]
    return [(data[:, p].astype(kind) @ queries[:, p].astype(kind).T).astype(np.int64) for p in parts]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
    else:
        among = np.arange(len(score))
    return among[np.lexsort((ids[among], -score[among]))[:k]]


def phase(k: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Works on pairs of a vector block and a query block."""

    def pair(ids: np.ndarray, data: np.ndarray, names: np.ndarray, queries: np.ndarray, bound: np.ndarray | None) -> Iterator[tuple[int, int, int]]:
        parts = partial_scores(data, queries)
        for q, name in enumerate(names):
            others = ids != name
            if first:
                # phase 1: the leaders of every list, resolved
                seen = np.unique(np.concatenate([best(np.where(others, p[:, q], np.iinfo(np.int64).min), ids, k) for p in parts]))
                seen = seen[others[seen]]
            else:
                # phase 2: entries at or above the uniform threshold; phase 3: the rest of their scores
                seen = np.flatnonzero(others & np.any([p[:, q] >= -(-int(bound[q]) // len(parts)) for p in parts], axis=0)) if bound[q] > np.iinfo(np.int64).min else np.flatnonzero(others)
            score = np.sum([p[seen, q] for p in parts], axis=0, dtype=np.int64)
            if not first:
                seen, score = seen[score >= bound[q]], score[score >= bound[q]]
            for i in best(score, ids[seen], k):
                yield int(name), int(ids[seen[i]]), int(score[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, queries = matrix(row["qids"], row["qvalues"], row["qwidth"])
                bound = None if first else np.frombuffer(row["bounds"], np.int64)
                out = list(pair(*matrix(row["ids"], row["values"], row["width"]), names, queries, bound))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    return run


def pairs(data: DataFrame, queries: DataFrame, count: int, step: int = 1) -> DataFrame:
    """Every query block with every vector block, once: query blocks, the smaller side, are sent to
    every `step`-th of the places 0 to count - 1 of the vector blocks."""
    sent = queries.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(count - 1), F.lit(step))))
    return data.where(F.col("place") % step == 0).repartition(-(-count // step), "place").join(sent, "place").drop("place", "block", "qblock")


def with_bounds(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """The query blocks with the bound of each query, the least number where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, found in zip(batch.column("qids").to_pylist(), batch.column("found").to_pylist(), strict=True):
                known = {x["query_id"]: x["bound"] for x in found or []}
                out.append(np.array([known.get(i, np.iinfo(np.int64).min) for i in np.frombuffer(ids, np.int64).tolist()], np.int64).tobytes())
            yield batch.drop_columns(["found"]).append_column("bounds", pa.array(out, pa.binary()))

    own = queries.join(bounds.groupBy("qblock").agg(F.collect_list(F.struct("query_id", "bound")).alias("found")), "qblock", "left")
    return own.select("qblock", "qids", "qvalues", "qwidth", "found").mapInArrow(run, "qblock long, qids binary, qvalues binary, qwidth int, bounds binary")


def ids_of(queries: DataFrame) -> DataFrame:
    """query_id, qblock."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("qblock").to_pylist(), batch.column("qids").to_pylist(), strict=True):
                names = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), block))], names=["query_id", "qblock"])

    return queries.select("qblock", "qids").mapInArrow(run, "query_id long, qblock long")


def exact_top_k(embeddings: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row with
    the rows of other vec_ids, ties to smaller ids; all, if there are fewer.

    is_query is a condition on vec_id. Vectors of different lengths are compared as if filled with
    zeros. Equal rows (vec_id and vector) count once; different vectors under one vec_id each
    count, as queries too. An empty table gives no rows. Other columns are ignored, whatever their
    names. Components, and scores, that do not fit a long raise an error."""
    session_of(embeddings)
    rows = stored(integer_vectors(embeddings).dropDuplicates(["vec_id", "v"]), "vectors")
    data = stored(blocks(rows, BLOCK), "blocks")
    count = max(1, data.count())
    # a vector block's place: its number among all. Only names are numbered, as few as rows / BLOCK
    places = data.select("block").withColumn("place", F.row_number().over(Window.orderBy("block")) - 1)
    data = data.join(places, "block")
    queries = blocks(rows.where(is_query).coalesce(max(1, count // 4)), QUERY_BLOCK).toDF("qblock", "qids", "qvalues", "qwidth")
    queries = stored(queries, "queries")

    shape = "query_id long, vec_id long, score long"
    leaders = pairs(data, queries, count, SPARSE).mapInArrow(phase(k, True), shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = leaders.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound")).where("bound IS NOT NULL")
    queries = stored(with_bounds(queries, ids_of(queries).join(bounds, "query_id")), "bounds")
    found = pairs(data, queries, count).mapInArrow(phase(k, False), shape)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
