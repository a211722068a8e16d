"""Removal of repeated passages with sharded FM-indexes (operator 2).

Windows of `span` words are matched. The least hash of the word n-grams in a window is its key;
neighbouring windows with one key form a run. Only keys that start in two different texts matter,
so all other text never leaves the scan. Runs that remain are cut out as segments and dealt to
shards such that equal windows meet in one shard. Each shard builds an FM-index (a wavelet matrix
over the Burrows-Wheeler transform of its segments) and streams the segments through it by
backward search; the interval of each matched window tells the smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, doc_texts, free_prefix, lean, met, scratch, session_of, stored, word_hashes

#: Words of the n-grams whose least hash keys a window.
GRAM = 8
#: Words that a shard should hold: documents that own more are dealt by key, not by owner.
SHARD_WORDS = 200_000
#: Words of one key that an index can hold (about 100 bytes each); beyond, every window is dealt by
#: its own hash, at the cost of a row for each.
KEY_WORDS = 2_000_000
#: Windows of one streamed pattern: longer segments are streamed in overlapping parts.
STREAM_WINDOWS = 200
BASE = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").digest()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    return out * BASE


def window_runs(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each run of windows with one key."""
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = min(GRAM, span)
    least, width, across = grams(h, n), 1, span - n + 1
    while width < across:
        step = min(width, across - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[start].view(np.int64), start, np.diff(np.append(start, len(least)))


class FMIndex:
    """Over segments of symbols, each owned by a document; finds windows of `span` symbols."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, span: int):
        sizes = np.array([len(s) for s in segments])
        flat = np.concatenate(segments)
        self.symbols, dense = np.unique(flat, return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(ends[-1] + 1, np.int64)  # 0 ends each segment
        held = np.ones(len(text), bool)
        held[ends] = False
        text[held] = dense + 1
        owner = np.repeat(owners, sizes + 1)
        n = len(text)
        # suffixes in order of their first `span` symbols at least, by prefix doubling
        rank, width, at_half = text, 1, None
        while True:
            order = np.argsort(rank, kind="stable")
            put = rank[order]
            fresh = np.concatenate([[0], np.cumsum(put[1:] != put[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh + 1
            if width > span:
                break
            if 2 * width > span - 1 and at_half is None:
                at_half = (rank, width)
            later = np.zeros(n, np.int64)
            if width < n:
                later[:-width] = rank[width:]
            rank = rank * (n + 2) + later
            width *= 2
        self.order = order
        half, width = at_half

        def group(depth: int) -> np.ndarray:
            """Numbers the runs of suffixes that agree on their first `depth` symbols."""
            names = np.zeros(n, np.int64)
            skip = depth - width
            names[: n - skip] = half[skip:]
            a, b = half[order], names[order]
            return np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])

        self.short = group(span - 1)
        self.short_start = np.append(np.flatnonzero(np.diff(self.short, prepend=-1)), n)
        self.whole = group(span)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(np.diff(self.whole, prepend=-1)))
        # wavelet matrix of the transform
        last = text[order - 1]
        size = len(self.symbols) + 1
        count = np.cumsum(np.bincount(last, minlength=size))
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        every = np.zeros(size, np.int64)
        names = np.arange(size)
        for level in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            zeros = len(bit) - int(bit.sum())
            self.levels.append((level, zeros, packed, ones))
            every = self.descend(every, names >> level & 1, self.levels[-1])
            last = np.concatenate([last[~bit], last[bit]])
        self.base = np.concatenate([[0], count[:-1]]) - every
        self.n, self.span = n, span

    @staticmethod
    def descend(at: np.ndarray, bit: np.ndarray, level: tuple[int, int, np.ndarray, np.ndarray]) -> np.ndarray:
        _, zeros, packed, ones = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        before = ones[word] + np.bitwise_count(packed[word] & mask)
        return np.where(bit.astype(bool), zeros + before, at - before)

    def step(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Interval bounds after one more symbol to the left."""
        base = self.base[symbol]
        for level in self.levels:
            at = self.descend(at, symbol >> level[0] & 1, level)
        return at + base

    def first_owners(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each pattern the smallest owner of each of its windows; -1: nowhere. All patterns
        advance together, from their last symbols on. A match that is `span` long is reported, then
        gives up its last symbol: its interval widens to the suffixes that share span - 1 symbols."""
        span = self.span
        order = np.argsort([-len(p) for p in patterns], kind="stable")
        sizes = np.array([len(patterns[i]) for i in order])
        ends = np.cumsum(sizes)
        flat = np.concatenate([patterns[i] for i in order])
        symbol = np.minimum(np.searchsorted(self.symbols, flat), len(self.symbols) - 1)
        symbol = np.where(self.symbols[symbol] == flat, symbol + 1, 0)
        found = np.full(len(flat), -1, np.int64)
        low, high, depth = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        broken = np.zeros(len(sizes), bool)
        for t in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -t, "left"))  # patterns longer than t
            c = symbol[ends[:k] - 1 - t]
            lo, hi, d = low[:k], high[:k], depth[:k]
            full = d == span
            if full.any():
                g = self.short[np.where(full, lo, 0)]
                lo, hi, d = np.where(full, self.short_start[g], lo), np.where(full, self.short_start[g + 1], hi), np.where(full, span - 1, d)
            both = self.step(np.concatenate([lo, hi]), np.concatenate([c, c]))
            lo, hi = both[:k], both[k:]
            gone = (c == 0) | (lo >= hi)  # no match through this symbol
            broken[:k] |= gone
            low[:k], high[:k], depth[:k] = np.where(gone, 0, lo), np.where(gone, self.n, hi), np.where(gone, 0, d + 1)
            at = np.flatnonzero(depth[:k] == span)
            found[ends[at] - 1 - t] = self.least[self.whole[low[at]]]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(patterns)
        for i, end, size in zip(order, ends, sizes, strict=True):
            out[i] = found[end - size : end][: max(0, size - span + 1)]
        # a pattern that the index does not hold throughout: its windows one by one
        again = [i for i, b in zip(order, broken, strict=True) if b and len(patterns[i]) > span]
        if again:
            found = self.first_owners([patterns[i][k : k + span] for i in again for k in range(len(patterns[i]) - span + 1)])
            each = iter(found)
            for i in again:
                out[i] = np.concatenate([next(each) for _ in range(len(patterns[i]) - span + 1)])
        return out


def scanned(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, n_words, text_key (SHA-256 of the words joined by a space), runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            keys, counts, lists = [], [], []
            for text in byte_column(batch, "text"):
                words = (text or b"").split()
                counts.append(len(words))
                keys.append(hashlib.sha256(b" ".join(words)).digest())
                lists.append(window_runs(word_hashes(words), span))
            ends = np.cumsum([0, *(len(a) for a, _, _ in lists)])
            flat = [pa.array(np.concatenate([x[i] for x in lists])).cast(t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=["key", "at", "n"]), type=kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), runs], names=["doc_id", "n_words", "text_key", "runs"])

    return docs.mapInArrow(lean(run), "doc_id long, n_words long, text_key binary, runs array<struct<key:long,at:int,n:int>>")


def cut_segments(texts: DataFrame, span: int) -> DataFrame:
    """The segments of texts (doc_id, text, text_key, runs: at, n, deal, fine): neighbouring runs
    with one deal become one segment; the windows of a `fine` run become segments of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, key, doc, runs in zip(byte_column(batch, "text"), *(batch.column(c).to_pylist() for c in ("text_key", "doc_id", "runs")), strict=True):
                words = (text or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() != key:
                    continue  # another text under the same doc_id
                h = word_hashes(words)
                merged: list[list[int]] = []
                for r in sorted(runs, key=lambda r: r["at"]):
                    at, n, deal = r["at"], r["n"], r["deal"]
                    if r["fine"]:
                        merged += [[xxhash.xxh3_64_intdigest(h[i : i + span].tobytes()) - (1 << 63), i, 1] for i in range(at, at + n)]
                    elif merged and merged[-1][0] == deal and merged[-1][1] + merged[-1][2] == at:
                        merged[-1][2] += n
                    else:
                        merged.append([deal, at, n])
                for deal, at, n in merged:
                    raw = h[at : at + n + span - 1].tobytes()
                    rows.append((deal, xxhash.xxh3_128_digest(raw), raw, key, doc, at))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["deal", "segment_key", "words", "text_key", "doc_id", "at"])

    return texts.select("doc_id", "text", "text_key", "runs").mapInArrow(lean(run), "deal long, segment_key binary, words binary, text_key binary, doc_id long, at int")


def search(key: tuple, shard: pa.Table) -> pa.Table:
    """Indexes a shard's segments and streams them through the index."""
    span = key[1].as_py()
    shard = shard.sort_by([("deal", "ascending"), ("segment_key", "ascending")])
    segments = [np.frombuffer(x, np.uint64) for x in shard.column("words").to_pylist()]
    index = FMIndex(segments, shard.column("doc_id").to_numpy(), span)
    parts = [(i, s[at : at + STREAM_WINDOWS + span - 1]) for i, s in enumerate(segments) for at in range(0, len(s) - span + 1, STREAM_WINDOWS)]
    firsts: list[list[np.ndarray]] = [[] for _ in segments]
    for (i, _), f in zip(parts, index.first_owners([p for _, p in parts]), strict=True):
        firsts[i].append(f)
    return shard.select(["deal", "segment_key"]).append_column("firsts", pa.array([np.concatenate(f) for f in firsts], pa.list_(pa.int64())))


def repeated_spans(docs: DataFrame, span: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: doc_id, n_words, text_key, first (the smallest doc_id with that text).
    spans: text_key and, for the text's first document, spans of words [start, stop) to remove."""
    spark = session_of(docs)
    with scratch(spark):
        return found_spans(doc_texts(docs).where("doc_id IS NOT NULL"), span)


def found_spans(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """repeated_spans(), both stored."""
    found = stored(scanned(docs, span), "scanned")
    # the copies of a very common text, or empty ones, do not meet in one task
    texts = stored(found.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")), "texts")
    rows = stored(met(found.select("doc_id", "n_words", "text_key"), texts, ["text_key"]), "rows", keep=True)
    # one row for each distinct text: copies of a whole text never meet in a shard
    firsts = texts.select("text_key", F.col("first").alias("doc_id"))
    own = found.where("size(runs) > 0").join(firsts, ["text_key", "doc_id"]).dropDuplicates(["text_key"])
    run = stored(own.select("text_key", "doc_id", F.inline("runs")), "runs")
    keys = run.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high"), F.sum(F.col("n") + span - 1).alias("held")).where("owner < high")
    keys = stored(keys, "keys")
    owners = keys.groupBy("owner").agg(F.sum("held").alias("owned"))
    keys = keys.join(owners, "owner").select("key", F.when(F.col("owned") <= SHARD_WORDS, F.col("owner")).otherwise(F.col("key")).alias("deal"), ((F.col("owned") > SHARD_WORDS) & (F.col("held") > KEY_WORDS)).alias("fine"))
    wanted = run.join(keys, "key").groupBy("text_key", "doc_id").agg(F.collect_list(F.struct("at", "n", "deal", "fine")).alias("runs"))
    segments = stored(cut_segments(docs.join(wanted, "doc_id"), span), "segments")
    distinct = segments.groupBy("deal", "segment_key").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    total = segments.select(F.sum(F.length("words") / 8)).first()[0] or 0
    shards = max(1, round(total / SHARD_WORDS))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards))).withColumn("span", F.lit(span))
    first = dealt.groupBy("shard", "span").applyInArrow(search, "deal long, segment_key binary, firsts array<long>")
    hits = segments.select("deal", "segment_key", "text_key", "doc_id", "at").join(first, ["deal", "segment_key"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keep = [], []
            for i, (doc, at, firsts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "firsts")), strict=True)):
                x = np.array(firsts, np.int64)
                hit = np.flatnonzero((x >= np.iinfo(np.int64).min) & (x < doc)) + at
                if len(hit):
                    gap = np.flatnonzero(np.diff(hit) > 1)
                    keep.append(i)
                    lists.append([{"start": int(a), "stop": int(b) + span} for a, b in zip(hit[np.append(0, gap + 1)], hit[np.append(gap, len(hit) - 1)], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(keep, pa.int32())), pa.array(lists, kind)], names=["text_key", "spans"])

    hits = hits.select("text_key", "doc_id", "at", "firsts").mapInArrow(lean(spans), "text_key binary, spans array<struct<start:int,stop:int>>")
    removed = stored(hits.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans", keep=True)
    return rows, removed


def kept_mask(n: int, spans: list[dict]) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    return np.cumsum(gone)[:n] == 0


def dedup_digest(docs: DataFrame, span: int = 50) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words are what stands between ASCII white space. A word goes if a window of `span` words that
    covers it, in the text as given, also starts in a document with a smaller doc_id. A null or
    empty text has no words; one with fewer words than a window keeps all. Repeated rows each give
    a row; an equal doc_id is not a smaller one. Rows without a doc_id give none. Other columns are
    ignored."""
    rows, removed = repeated_spans(docs, span)
    texts = doc_texts(docs).where("doc_id IS NOT NULL")
    own = rows.where("doc_id = first").join(removed, "text_key").dropDuplicates(["text_key"]).select("doc_id", "text_key", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, key, spans in zip(byte_column(batch, "text"), batch.column("text_key").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() == key:
                    keep = kept_mask(len(words), spans)
                    out.append((key, int(len(words) - keep.sum()), hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).digest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["text_key", "gone", "left"])

    cut = texts.join(own, "doc_id").select("text", "text_key", "spans").mapInArrow(lean(digest), "text_key binary, gone long, left binary").dropDuplicates(["text_key"])
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= span)
    return rows.join(cut, "text_key", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("left", "text_key")))).alias("kept_sha256"),
    )


def dedup_text(docs: DataFrame, span: int = 50) -> DataFrame:
    """docs with the repeated words cut out of text, white space around what stays as it was. Rows
    of which no word is left go; rows without repeats, also null and empty texts, stay as they are."""
    rows, removed = repeated_spans(docs, span)
    name = free_prefix(docs.columns) + "cuts"
    copies = rows.where((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= span)).select("doc_id", "text_key", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"))
    cuts = stored(rows.where("doc_id = first").join(removed, "text_key").select("doc_id", "text_key", "spans").union(copies).groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "spans")).alias(name)), "cuts")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for i, (text, cuts) in enumerate(zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True)):
                if cuts:
                    raw = (text or "").encode()
                    words = raw.split()
                    own = [c for c in cuts if c["text_key"] == hashlib.sha256(b" ".join(words)).digest()]
                    if own:
                        mask = np.zeros(len(words), bool) if any(c["spans"] is None for c in own) else kept_mask(len(words), own[0]["spans"])
                        if not mask.any():
                            continue
                        parts, at = [], 0
                        for w, k in zip(words, mask.tolist(), strict=True):
                            start = raw.index(w, at)
                            stop = start + len(w)
                            parts.append(raw[at : stop] if k else b"")
                            at = stop
                        text = (b"".join(parts) + raw[at:]).decode().strip()
                keep.append(i)
                out.append(text)
            batch = batch.take(pa.array(keep, pa.int32()))
            arrays = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.join(cuts, "doc_id", "left").mapInArrow(lean(cut), docs.schema)
