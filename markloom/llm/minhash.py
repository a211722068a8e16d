"""Near-duplicate documents by circulant MinHash (operator 6).

A document is its set of distinct 5-word shingles. Two permutations of the 32-bit numbers give all
signature coordinates: s orders the shingles once, and coordinate k is the least p(s(x) + k mod
2^32) over the set, that is p circularly shifted by k. Bands of coordinates propose pairs; a link
holds only if the full sets confirm it. Equal sets are one class from the start, so copies are
never compared.

Within a bucket the first pass compares each class with one centre. Buckets that still hold
several components afterwards are compared in tiles of bounded size, across components only, so
that no link is lost and no pair inside a component is listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_column, doc_texts, free_prefix, lean, met, scratch, session_of, stored, word_hashes

WORDS, BANDS, ROWS = 5, 30, 5
#: Shingles of one side of a tile.
TILE_SHINGLES = 1 << 19
#: An odd multiplier: shingles are polynomials of word hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z lower-cased, words between ASCII white
    space. Fewer words than a shingle are one shingle; no words are the empty set."""
    h = word_hashes((text or b"").lower().split())
    if not len(h):
        return h
    take = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - take + 1, take, np.uint64)
        for k in range(take):
            out = out * BASE + h[k : len(h) - take + 1 + k]
        out ^= out >> np.uint64(29)
        out *= BASE
    return np.unique(out)


def permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    return x


def signature(found: np.ndarray, size: int) -> np.ndarray:
    """The `size` circulant MinHash coordinates of a set that is not empty."""
    s = permuted((found >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift, least = np.arange(size, dtype=np.uint32), np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 512):
        np.minimum(least, permuted(s[at : at + 512, None] + shift, 0x21F0AAAD, 0x735A2D97).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature, different between bands."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)) * BASE
        for r in np.moveaxis(signatures.reshape(len(signatures), bands, -1).astype(np.uint64), 2, 0):
            key = (key ^ r) * BASE
            key = key ^ key >> np.uint64(31)
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (fingerprint of the set, null if it is empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, words) for x in byte_column(batch, "text")]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = np.array([signature(s, bands * rows) for s in sets if len(s)], np.uint32).reshape(-1, bands * rows)
            listed = iter(band_keys(signed, bands))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(listed) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """node, shingles (the sorted set as bytes) of the given classes, from their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingles(x, words).tobytes() for x in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["node", "shingles"])

    wanted = classes.select(F.col("node").alias("doc_id")).distinct()
    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(lean(run), "node long, shingles binary").where("length(shingles) > 0")


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * shared >= percent * (a + b - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("set_a", "set_b"))
            keep = [bool(similar(min(len(s), len(t)), len(s), len(t), percent) and similar(len(np.intersect1d(s, t, True)), len(s), len(t), percent)) for s, t in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node with a link: least labels pass
    along links, then labels take the label of their label, until nothing changes. A hub's links, and
    the nodes of a large component, are dealt over many tasks by met()."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    total = both.count()
    while True:
        sent = labels.select(F.col("node").alias("b"), F.col("degree").alias("copies"), "component")
        near = met(both, sent, ["b"], total).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = stored(labels.join(near, "node").select("node", "degree", F.col("component").alias("was"), F.least("component", "least").alias("component")), "step")
        size = step.groupBy("component").agg(F.count("*").alias("copies"))
        jump = size.join(step.select(F.col("node").alias("component"), F.col("component").alias("further")), "component")
        # a component is a node, so each has its row
        new = stored(met(step, jump, ["component"], labels.count()).select("node", "degree", "was", F.least("component", "further").alias("component")), "labels")
        labels = new.select("node", "degree", "component")
        if new.where("was <> component").isEmpty():
            return labels.select("node", "component")


def tile_links(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Compares the classes of a tile's sides across components; gives the links found."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        rows = rows.sort_by("node")
        node, comp, side = (rows.column(c).to_numpy() for c in ("node", "component", "side"))
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        size = np.array([*map(len, sets)])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        merged: dict[int, int] = {}

        def root(c: int) -> int:
            while c in merged:
                c = merged[c]
            return c

        names, counts = np.unique(comp, return_counts=True)
        main, out = names[counts.argmax()], []
        for x in np.flatnonzero(comp != main):  # a pair across components has such an end
            other = (comp != comp[x]) & ((comp == main) | (node > node[x]))
            if i != j:
                other &= side != side[x]
            other &= similar(np.minimum(size, size[x]), size, size[x], percent)
            # only in the first bucket that both share
            other &= bands[np.arange(len(node)), (bands == bands[x]).argmax(axis=1)] == bucket
            if not other.any():
                continue
            mark = np.zeros(flat.max() + 1, bool)
            mark[flat[start[x] : start[x] + size[x]]] = True
            shared = np.add.reduceat(mark[flat], start)
            for y in np.flatnonzero(other & similar(shared, size, size[x], percent)):
                a, b = root(int(comp[x])), root(int(comp[y]))
                if a != b:
                    merged[max(a, b)] = min(a, b)
                    out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| over their sets of distinct shingles.
    component_id is the smallest doc_id that links reach, the document's own included, and kept is
    doc_id = component_id. A null or blank text has the empty set and no link. Rows with one doc_id
    are one node of the links; each of them gives a row. Rows without a doc_id give none.
    Other columns are ignored. A pair just similar enough shares no band, and so may be missed, with
    probability (1 - (percent / 100)^rows)^bands: 2e-8 at 85 percent with the defaults.
    """
    spark = session_of(docs)
    with scratch(spark):
        return linked(doc_texts(docs).where("doc_id IS NOT NULL"), percent, words, bands, rows)


def linked(docs: DataFrame, percent: int, words: int, bands: int, rows: int) -> DataFrame:
    """The rows of near_duplicates(), stored."""
    found = stored(sketches(docs, words, bands, rows), "sketches")
    classes = found.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = stored(classes, "classes")
    member = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    member = stored(member.join(shared, "bucket"), "members")
    pairs = member.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    sets = stored(full_sets(docs, member, words), "sets")
    links = stored(confirmed(pairs, sets, percent), "links")
    labels = components(links)

    # buckets that still hold more than one component
    labelled = member.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled, "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    rest = labelled.join(open_, "bucket").withColumn("tiles", F.ceil(F.col("total") / TILE_SHINGLES).cast("int"))
    rest = rest.withColumn("side", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.select("bucket", "node", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    rest = rest.join(classes.select("node", "bands"), "node").join(sets, "node")
    more = stored(rest.groupBy("bucket", "i", "j").applyInArrow(tile_links(percent), "a long, b long"), "more")
    if not more.isEmpty():
        labels = components(links.union(more))

    own = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "set_key").join(own, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return stored(out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "components", keep=True)


def keep_one(docs: DataFrame, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """docs without those that are in a group with a smaller doc_id, all columns kept. Of rows equal
    in doc_id and text one stays. Rows without a doc_id stay."""
    gone = near_duplicates(docs, percent, bands=bands, rows=rows).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    row = free_prefix(docs.columns) + "row"
    return left.withColumn(row, F.row_number().over(order)).where(F.col("doc_id").isNull() | (F.col(row) == 1)).drop(row)
