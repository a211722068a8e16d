"""Best-fit packing with certified bin counts (operator 7).

Documents become token pieces; pieces are packed into sequences of a fixed length. Every partition
packs its pieces by best-fit decreasing, and dual-feasible functions bound from below how many
sequences they need. Where both agree the partition is certified and done. Elsewhere the full
sequences stay, and the pieces of the sequences with gaps go to a pool that is dealt anew over
fewer partitions and packed again, until all are certified or one partition held all the pool.
A pool that hardly shrinks, or is left after the last round, is packed as one too: best-fit
decreasing needs lengths only, so the driver packs the counts of each length and the pieces find
their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Remembered, texts_as_ids, word_bpe
from .common import doc_texts, gathered, lean, session_of, stored

#: Pieces that one partition packs at a time, and the most rounds; the last packs what is left as one.
PARTITION_PIECES, ROUNDS = 50_000, 6
#: Bytes of text that are encoded together: a few more lookups of repeated parts, and less memory.
CALL_BYTES = 2 << 20
#: Parts and words that a worker remembers.
KEPT, WORDS = 400_000, 400_000
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Remembered, Callable[[list[bytes]], list[bytes]]]:
    """Per worker and file: the memory of parts of texts, and how new ones are encoded; their words
    have a memory too, as new parts are mostly made of known words."""
    bpe, words = word_bpe(path), Remembered(most=WORDS)
    return Remembered(most=KEPT), lambda parts: bpe.encode_parts(parts, lambda some: words.all(some, bpe.merge_together))


def token_pieces(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """The pieces of every row: its ids, then id 0, cut every `limit` ids. A null or empty text is
    the one id 0. Repeated rows are documents of their own. Other columns are ignored."""
    session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, make = encoder(vocabulary)
        for batch in gathered(batches, "text", CALL_BYTES):
            ids, ends = texts_as_ids(batch.column("text"), memory, make)
            sizes = np.diff(ends)
            count = sizes // limit + 1  # sizes + 1 ids, cut every `limit`
            row = np.repeat(np.arange(batch.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = piece * limit
            length = np.minimum(limit, sizes[row] + 1 - at)
            begin = ends[:-1][row] + at
            stop = np.minimum(begin + length, ends[1:][row])
            check = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            # id 0 ends the last piece of each text
            for i in np.flatnonzero(stop - begin < length).tolist():
                check[i] = zlib.crc32(bytes(4), check[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())], names=[x.split()[0] for x in PIECE_COLUMNS.split(", ")])

    return doc_texts(docs).mapInArrow(lean(run), PIECE_COLUMNS)


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """The most sequences that any of these dual-feasible functions proves necessary: the identity;
    for each e, lengths over limit - e count whole and those under e nothing; the rounding
    functions floor((k + 1) x) / k, exact multiples kept."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int(sizes @ counts) // limit)
    for e in sizes[sizes <= limit // 2]:
        value = np.where(sizes > limit - e, limit, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int(value @ counts) // limit))
    for k in range(2, 25):
        scaled = (k + 1) * sizes
        value = np.where(scaled % limit == 0, k * sizes, scaled // limit * limit)
        best = max(best, -(-int(value @ counts) // (k * limit)))
    return best


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its sequence and offset, and for each sequence the room that is left.
    Sequences wait in stacks by room; a bit mask finds the smallest room that is enough."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    room: list[int] = []
    mask = 0
    for i in order.tolist():
        n = int(lengths[i])
        if fits := mask >> n:
            left = n + (fits & -fits).bit_length() - 1
            at = stacks[left].pop()
            if not stacks[left]:
                mask ^= 1 << left
        else:
            at, left = len(room), limit
            room.append(limit)
        sequence[i], offset[i] = at, limit - left
        room[at] = left = left - n
        if left:
            stacks[left].append(at)
            mask |= 1 << left
    return sequence, offset, np.array(room, np.int64)


def packer(limit: int, turn: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs one partition and says which of its pieces are done."""

    def packed(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("__row")
        lengths = pieces.column("length").to_numpy()
        sequence, offset, room = best_fit_decreasing(lengths, limit)
        certified = len(room) == lower_bound(lengths, limit)
        over = np.full(len(lengths), True) if last or certified else room[sequence] == 0
        base = (turn + 1 << 56) + (key[0].as_py() << 32)
        for name, x in (("sequence_id", sequence + base), ("offset", offset), ("__done", over)):
            pieces = pieces.append_column(name, pa.array(x))
        return pieces

    return packed


def best_fit_counts(counts: dict[int, int], limit: int) -> np.ndarray:
    """best_fit_decreasing() of counts[n] pieces of each length n, alike sequences at once. Rows: length, the
    first rank of its pieces that the row holds for, their first sequence, pieces a sequence, offset."""
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    opened = mask = 0
    steps = []
    for n, count in sorted(counts.items(), reverse=True):
        rank = 0
        while rank < count:
            if fits := mask >> n:
                left = n + (fits & -fits).bit_length() - 1
                first, alike = stacks[left].pop()
                if not stacks[left]:
                    mask ^= 1 << left
            else:
                left, first, alike = limit, opened, -(-(count - rank) // (limit // n))
                opened += alike
            each = min(left // n, count - rank)
            filled = min(alike, (count - rank) // each)
            steps.append((n, rank, first, each, limit - left))
            rank += filled * each
            for room, some in ((left - each * n, (first, filled)), (left, (first + filled, alike - filled))):
                if room and some[1]:
                    stacks[room].append(some)
                    mask |= 1 << room
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def pack_as_one(pool: DataFrame, limit: int, turn: int, parts: int) -> DataFrame:
    """pool with sequence_id and offset, as if one partition packed all of it. `parts` tasks at
    least rank the pieces of a length, so a common length is not in one task."""
    counts = {r["length"]: r["count"] for r in pool.groupBy("length").count().collect()}
    steps = best_fit_counts(counts, limit)
    keys = steps[:, 0] << 48 | steps[:, 1]
    names = [c for c in pool.columns if c != "__row"]
    dealt = pool.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(parts)).cast("int"))
    dealt = stored(dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy("__row")).cast("long")), "ranked")
    sizes = dealt.groupBy("length", "__part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "__part", (F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n") - 1).alias("__before"))
    placed = dealt.join(before, ["length", "__part"]).select(*names, (F.col("__before") + F.col("__rank")).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            n, start, first, each, offset = steps[np.searchsorted(keys, length << 48 | rank, "right") - 1].T
            own = [pa.array((turn + 1 << 56) + first + (rank - start) // each), pa.array(offset + (rank - start) % each * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], names=[*names, "sequence_id", "offset"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema if f.name in names)
    return stored(placed.mapInArrow(lean(run), f"{shape}, sequence_id long, offset long"), "as-one")


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """pieces with sequence_id and offset. Lengths are 1 to limit. An empty table packs to an empty
    one; equal rows are packed each."""
    spark = session_of(pieces)
    names = pieces.columns
    pieces = stored(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    done = [pieces.where(F.col("length") >= limit).select(*names, (F.col("__row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool = pieces.where(F.col("length") < limit)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", __part int, sequence_id long, offset long, __done boolean"
    before = None
    for turn in range(ROUNDS):
        count = pool.count()
        if not count:
            break
        parts = -(-count // PARTITION_PIECES)
        if parts > 1 and (turn == ROUNDS - 1 or before is not None and count > 0.97 * before):
            done.append(pack_as_one(pool, limit, turn, parts))
            break
        before = count

        # a piece's partition is drawn anew in each round; every partition gets about as many pieces
        dealt = pool.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(parts)).cast("int"))
        result = stored(dealt.groupBy("__part").applyInArrow(packer(limit, turn, parts == 1), shape), f"packed{turn}")
        done.append(result.where("__done").select(*names, "sequence_id", "offset"))
        if parts == 1:
            break
        pool = result.where("NOT __done").select(*names, "__row")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Packs all documents into as few sequences of `limit` ids as it can: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. See token_pieces() and pack()."""
    return pack(token_pieces(docs, vocabulary, limit), limit)
