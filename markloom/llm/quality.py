"""A quality classifier: a factorisation machine (operator 9).

Inputs are hashed words, structure statistics in bins, and the n_chars metadata in bins. Pairwise
interactions have low rank: sum over pairs of <v_i, v_j> x_i x_j is half of (sum v_i x_i)^2 -
sum (v_i x_i)^2 for each factor, so a document is scored in time linear in its inputs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, free_prefix, give_back, lean, session_of, word_hashes

#: Word buckets, factors, bins of a statistic.
BUCKETS, FACTORS, BINS = 1 << 14, 8, 10
#: The most labelled rows that a model is fitted on: those with the least hash of their doc_id.
SAMPLE = 8000
EPOCHS, UPDATES, BATCH, RATE, DECAY, SEED = 12, 800, 64, 0.1, 2e-5, 7
CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"|", b"@/\\_=~^`{}[]", bytes(range(128, 256))]
STATISTICS = len(CLASSES) + 9


def structure(text: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Statistics of the whole text; all finite, also for an empty one."""
    size, n = max(1, len(text)), max(1, len(words))
    shares = [(len(text) - len(text.translate(None, c))) / size for c in CLASSES]
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        *shares,
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        max(Counter(words).values(), default=0) / n,
        float(np.log1p(max(0, len(text) if n_chars is None else n_chars))),
    ]


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: square roots of counts, of length 1 together."""
    at, count = np.unique((word_hashes(words) & np.uint64(BUCKETS - 1)).astype(np.int32), return_counts=True)
    return at, np.sqrt(count / max(1, count.sum())).astype(np.float32)


def inputs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    for text, n in zip(byte_column(batch, "text"), batch.column("n_chars").to_pylist(), strict=True):
        text = text or b""
        yield *word_inputs(text.lower().split()), structure(text, text.split(), n)


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    edges: np.ndarray  # statistics x (BINS - 1)

    def row(self, at: np.ndarray, x: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Words and binned statistics as one sparse row."""
        bins = (self.edges < np.asarray(stats)[:, None]).sum(axis=1)
        return np.concatenate([at, BUCKETS + np.arange(STATISTICS) * BINS + bins]), np.concatenate([x, np.full(STATISTICS, STATISTICS**-0.5, np.float32)])

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        z = self.bias + float(self.weight[at] @ x) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Logistic loss by sparse AdaGrad, in a fixed order: EPOCHS passes, and UPDATES steps at least.
    Without both labels: a constant score."""
    size, random = BUCKETS + STATISTICS * BINS, np.random.default_rng(SEED)
    stats = np.array([s for _, _, s in rows]).reshape(-1, STATISTICS)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(rows) else np.zeros((STATISTICS, BINS - 1))
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.05, (size, FACTORS)), edges)
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model
    sparse = [model.row(*r) for r in rows]
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // len(rows)))):
        order = random.permutation(len(rows))
        for some in np.array_split(order, -(-len(rows) // BATCH)):
            at = np.concatenate([sparse[i][0] for i in some])
            x = np.concatenate([sparse[i][1] for i in some]).astype(float)
            start = np.concatenate([[0], np.cumsum([len(sparse[i][0]) for i in some])[:-1]])
            doc = np.repeat(np.arange(len(some)), np.diff(np.append(start, len(at))))
            vx = model.factors[at] * x[:, None]
            s = np.add.reduceat(vx, start)
            z = model.bias + np.add.reduceat(model.weight[at] * x, start) + 0.5 * (s**2 - np.add.reduceat(vx**2, start)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            order_at = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order_at], prepend=-1))
            name, own = at[order_at][first], (error[doc] * x)[order_at]
            gw = np.add.reduceat(own, first) + DECAY * model.weight[name]
            gv = np.add.reduceat(own[:, None] * (s[doc] - vx)[order_at], first) + DECAY * model.factors[name]
            seen_w[name] += gw**2
            seen_v[name] += gv**2
            model.weight[name] -= RATE * gw / np.sqrt(seen_w[name])
            model.factors[name] -= RATE * gv / np.sqrt(seen_v[name])
            model.bias -= RATE * float(error.sum())
    return model


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 5


def slim(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model of labels.quality from at most `most` labelled rows outside fold 0. Labels that are
    null or lack a document do not count; a document labelled twice has its lower label."""
    session_of(docs)
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(own != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most `most` ids with their labels: broadcast of a bounded size
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, stats = zip(*inputs(batch), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "quality", "at", "x", "stats"])

    # of rows that share a doc_id one counts, so that the sample is bounded in rows
    chosen = slim(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), F.coalesce("n_chars", F.lit(-1)))).alias("x"))
    found = chosen.select("doc_id", "x.text", "x.n_chars", "quality").mapInArrow(lean(run), "doc_id long, quality int, at array<int>, x array<float>, stats array<double>").toArrow()
    found = found.sort_by([("doc_id", "ascending")])
    rows = list(zip(*(arrays(found.column(c).combine_chunks()) for c in ("at", "x", "stats")), strict=True))
    model = fit(rows, (found.column("quality").to_numpy() > 0).astype(float))
    del found, rows
    give_back()
    return model


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text scores as an empty one. Texts
    of any length count whole. lang, source, labels and doc_id are no inputs. Repeated rows each give
    a row, an empty table none. n_chars may be absent, null or of any type that casts to a number;
    other columns are ignored, whatever their names."""
    session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(*model.row(*r)) for r in inputs(batch)]
            ids = batch.column("doc_id")
            out = [fold(i) == 0 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return slim(docs).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least the threshold, by the rules of score(), with all their
    columns, whatever their names. Repeated rows are scored each; an empty table stays empty."""
    session_of(docs)
    new = free_prefix(docs.columns)
    whole = docs.select("*", *(c.alias(new + n) for n, c in (("text", F.col("text").cast("string")), ("n_chars", F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select([new + "text", new + "n_chars"]).rename_columns(["text", "n_chars"])
            yield batch.select(names).filter(pa.array([model.score(*model.row(*r)) >= threshold for r in inputs(own)], pa.bool_()))

    names = docs.columns
    return whole.mapInArrow(lean(run), docs.schema)
