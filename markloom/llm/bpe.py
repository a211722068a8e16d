"""Byte-pair encoding over a public vocabulary file (operator 8), and the token counts that
operator 7 packs.

A file of the tokenizers library is read for its vocabulary, merge list and special tokens. The
supported shape is: NFC, runs of white space to one space, lower case; words split by a regular
expression; bytes spelled as printable characters; merges with an end-of-word suffix; no
post-processor and no decoder. Any other shape raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify
from heapq import heappop as pop
from heapq import heappush as push

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import doc_texts, gathered, lean, session_of

#: Distinct parts of texts, and words, that a worker remembers, and the longest in bytes: some 200
#: bytes each, under 600 at worst.
PARTS, WORDS, LONGEST = 120_000, 600_000, 64
#: Longest word that is merged beside others, and how many are.
SHORT, TOGETHER = 64, 20_000
NONE = np.int32(2**31 - 1)
#: Bytes of text that are encoded together: a part that they repeat is looked up once.
CALL_BYTES = 8 << 20

#: Above any id: packs a pair into one integer.
ROOM = 1 << 24


def byte_names() -> list[str]:
    """For each byte its printable character: itself if it prints, else the next one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encodes text to ids and ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"] else {}
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split.get("invert") or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-casing word BPE without decoder")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank_of = {self.vocab[a] * ROOM + self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}.get
        self.union = [self.vocab[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.shortest = min(map(len, self.special), default=1 << 30)
        self.word_at = regex.compile(split["pattern"]["Regex"])
        self.usual = regex.compile(r"[\t-\r -~\xA0-\u024F]*").fullmatch
        self.path = path
        names = byte_names()
        self.byte_of = {c: b for b, c in enumerate(names)}
        self.first = [self.vocab[c] for c in names]
        self.last = [self.vocab[c + self.suffix] for c in names]
        pair = np.array([self.vocab[a] * ROOM + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(pair)
        self.pairs, self.ranks = np.append(pair[order], np.iinfo(np.int64).max), np.append(order.astype(np.int32), NONE)
        self.unions = np.array(self.union, np.int64)

    @cached_property
    def byte_ranks(self) -> np.ndarray:
        """The merge rank of each two bytes that follow each other, at a * 512 + b; + 256 if b ends its word."""
        first, last = np.array(self.first, np.int64), np.array(self.last, np.int64)
        return self.rank(np.repeat(first, 512), np.tile(np.concatenate([first, last]), 256))

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @cached_property
    def spelled(self) -> pa.Array:
        """By id, each string as it stands in a decoded text, with the space after it."""
        strings = {i: s for s, i in (self.vocab | self.special).items()}
        return pa.array([strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)], pa.large_binary())

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word. A priority queue holds the candidate merges by rank, then place, over
        a doubly linked list of symbols. `live` has the rank that the symbol and its successor now
        have (-1: none); a queue entry that says otherwise is stale and skipped."""
        n = len(word) - 1
        ids = [*map(self.first.__getitem__, word[:n]), self.last[word[n]]]
        if not n:
            return ids
        rank_of, union = self.rank_of, self.union
        live = [rank_of(a * ROOM + b, -1) for a, b in zip(ids, ids[1:])]
        bits = max(12, n.bit_length())
        mask = (1 << bits) - 1
        queue = [rank << bits | i for i, rank in enumerate(live) if rank >= 0]
        if not queue:
            return ids
        live.append(-1)
        after, before = [*range(1, n + 1), -1], [*range(-1, n)]
        if len(queue) > 1:
            heapify(queue)
        while queue:
            rank = pop(queue)
            i = rank & mask
            rank >>= bits
            if live[i] != rank:
                continue
            j = after[i]
            k = after[j]
            ids[i] = found = union[rank]
            ids[j] = live[j] = live[i] = -1
            after[i] = k
            if k >= 0:
                before[k] = i
                live[i] = rank = rank_of(found * ROOM + ids[k], -1)
                if rank >= 0:
                    push(queue, rank << bits | i)
            h = before[i]
            if h >= 0:
                live[h] = rank = rank_of(ids[h] * ROOM + found, -1)
                if rank >= 0:
                    push(queue, rank << bits | h)
        return [x for x in ids if x >= 0]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, NONE where they do not merge."""
        pair = left * ROOM + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], NONE)

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word as bytes: in each round every word merges its pair of least rank,
        the leftmost of equal ones. Long words are merged alone, in a queue."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        if len(short) < len(words):
            for i, w in enumerate(words):
                if len(w) > SHORT:
                    out[i] = np.array(self.merge(w), "<u4").tobytes()
        first, last = np.array(self.first, np.int64), np.array(self.last, np.int64)
        for k in range(0, len(short), TOGETHER):
            own = short[k : k + TOGETHER]
            name = np.array(own)
            size = np.fromiter((len(words[i]) for i in own), np.int64, len(own))
            raw = np.frombuffer(b"".join([words[i] for i in own]), np.uint8)
            ids = first[raw]
            ends = np.cumsum(size)
            ids[ends - 1] = last[raw[ends - 1]]
            next_to = raw.astype(np.int32)
            next_to[ends - 1] += 256
            rank = np.append(self.byte_ranks[raw[:-1] * np.int32(512) + next_to[1:]], NONE)
            rank[ends - 1] = NONE
            while len(name):
                start = ends - size
                least = np.minimum.reduceat(rank, start)
                over = least == NONE
                if over.any():
                    done = ids.astype("<u4").tobytes()
                    for i, a, b in zip(name[over].tolist(), start[over].tolist(), ends[over].tolist(), strict=True):
                        out[i] = done[4 * a : 4 * b]
                    on = np.repeat(~over, size)
                    name, size, least, ids, rank = name[~over], size[~over], least[~over], ids[on], rank[on]
                    ends = np.cumsum(size)
                    if not len(name):
                        break
                    start = ends - size
                hit = np.flatnonzero(rank == np.repeat(least, size))
                at = hit[np.searchsorted(hit, start)]  # the first in each word
                ids[at] = self.unions[least]
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                final = at + 2 >= ends  # nothing after the merged pair
                rank[at] = np.where(final, NONE, self.rank(ids[at], ids[np.minimum(at + 2, len(ids) - 1)]))
                before = at[at > start] - 1
                rank[before] = self.rank(ids[before], ids[before + 1])
                ids, rank, size = ids[keep], rank[keep], size - 1
                ends = np.cumsum(size)
        return out

    def encode_parts(self, parts: list[bytes], merge: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids, as bytes, of each of many parts without white space. `merge` gives those of words."""
        blob = b" \0 ".join(parts)
        text = blob.decode("utf-8", "replace")
        odd: set[bytes] = set()
        if blob.count(b"\0") >= len(parts) or self.special_at.search(text):
            odd = {p for p in parts if b"\0" in p or self.special_at.search(p.decode("utf-8", "replace"))}
        if not (blob.isascii() or self.usual(text.replace("\0", " "))):
            odd |= {p for p in parts if not (p.isascii() or self.usual(p.decode("utf-8", "replace")))}
        plain = [p for p in parts if p not in odd] if odd else parts
        out: list[bytes] = []
        if plain:
            # NUL words part the parts
            text = b" \0 ".join(plain).decode("utf-8", "replace") if odd else text
            words = pa.array([*self.plain_words(text), "\0"], pa.large_string()).dictionary_encode()
            names, each = words.dictionary.view(pa.large_binary()).to_pylist(), words.indices.to_numpy()
            mark = names.index(b"\0")
            ids = merge(names[:mark] + names[mark + 1 :])
            ids.insert(mark, b"")
            raw = pa.array(ids, pa.large_binary()).take(words.indices)
            at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1)
            data = raw.buffers()[2].to_pybytes() if raw.buffers()[2] else b""
            stops = at[np.flatnonzero(each == mark)].tolist()
            out = [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        if not odd:
            return out
        found = dict(zip(plain, out, strict=True)) | {p: np.array(self.chunk(p.decode("utf-8", "replace")), "<u4").tobytes() for p in odd}
        return [found[p] for p in parts]

    def plain_words(self, text: str) -> list[str]:
        return self.word_at.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())

    def words(self, text: str) -> list[bytes]:
        """Normalised and split, without special tokens."""
        if not (text.isascii() or self.usual(text)):
            # what this Python's Unicode tables may know otherwise: the library's own front end
            parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in parts]
        return [x.encode() for x in self.plain_words(text)]

    def chunk(self, text: str, merge: Callable[[bytes], list[int]] | None = None) -> list[int]:
        """The ids of any text. White space parts words and is dropped, so the ids of a text are
        those of its parts between ASCII white space, one after the other."""
        ids, start, merge = [], 0, merge or self.merge
        for m in self.special_at.finditer(text) if len(text) >= self.shortest else ():
            ids += [i for word in self.words(text[start : m.start()]) for i in merge(word)]
            ids.append(self.special[m[0]])
            start = m.end()
        return ids + [i for word in self.words(text[start:]) for i in merge(word)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of ids, of which ends[k] to ends[k + 1] are text k's: the vocabulary's strings
        one after the other; a file without decoder joins them with a space."""
        raw = self.spelled.take(pa.array(ids))
        size = np.frombuffer(raw.buffers()[1], np.int64, len(ids) + 1, raw.offset * 8)
        data = memoryview(raw.buffers()[2])
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(size[ends[:-1]].tolist(), size[ends[1:]].tolist(), strict=True)]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    """One per worker and file."""
    return WordBPE(path)


class Remembered(dict):
    """What `make` gives for a part of a text, kept for later parts that are equal. Of parts up to
    LONGEST bytes the last `most` that came anew are kept, and those among as many before them that
    came again since; longer ones are made each time."""

    def __init__(self, make: Callable[[bytes], object] | None = None, most: int = PARTS):
        self.make, self.most, self.old = make, most // 2, {}

    def keep(self, part: bytes, found: object) -> object:
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found

    def __missing__(self, part: bytes) -> object:
        found = self.old.get(part)
        return self.keep(part, self.make(part) if found is None else found)

    def all(self, parts: list[bytes], make: Callable[[list[bytes]], list], often: list[bool] | None = None) -> list:
        """For each of distinct parts what `make` gives for it; `make` gets the new ones together. Of
        these only those marked in `often` are kept."""
        found = list(map(self.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh, known = [], {}
        for i, x in zip(missing, map(self.old.get, [parts[i] for i in missing]), strict=True):
            if x is None:
                fresh.append(i)
            else:
                found[i] = known[parts[i]] = x
        made = make([parts[i] for i in fresh]) if fresh else []
        for i, x in zip(fresh, made, strict=True):
            found[i] = x
            if (often is None or often[i]) and len(parts[i]) <= LONGEST:
                known[parts[i]] = x
        if len(self) + len(known) <= self.most:
            self.update(known)
        else:
            for part, x in known.items():
                self.keep(part, x)
        return found


def texts_as_ids(texts: pa.Array, memory: Remembered, make: Callable[[list[bytes]], Iterable[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's begin, with the end last.
    `make` gives the ids of parts between ASCII white space as little-endian unsigned 32-bit
    integers; every distinct part is looked up once."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.frombuffer(split.buffers()[1], np.int64 if pa.types.is_large_list(split.type) else np.int32, len(split) + 1, 0)
    coded = split.values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    often = (np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) > 1).tolist() if len(coded) else []
    distinct = memory.all(coded.dictionary.view(pa.large_binary()).to_pylist(), make, often)
    raw = pa.array(distinct, pa.large_binary()).take(coded.indices)
    size = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 0) // 4
    ids = np.frombuffer(raw.buffers()[2], "<u4", size[-1]) if len(raw) and size[-1] else np.zeros(0, "<u4")
    return ids, size[ends] if len(raw) else np.zeros(len(split) + 1, np.int64)


@lru_cache(maxsize=2)
def part_maker(path: str) -> tuple[Remembered, Callable[[list[bytes]], list[bytes]]]:
    """Per worker, over all its tasks: the memory of parts, and how new ones are encoded."""
    bpe, words = word_bpe(path), Remembered(most=WORDS)

    def merge(some: list[bytes]) -> list[bytes]:
        return words.all(some, lambda new: [np.array(bpe.merge(w), "<u4").tobytes() for w in new])

    return Remembered(), lambda parts: bpe.encode_parts(parts, merge)


def encode_decode(docs: DataFrame, vocabulary: str, digest: bool = True) -> DataFrame:
    """doc_id, n_tokens, and either digests (ids_sha256, decoded_sha256) or the values themselves
    (ids array<int>, decoded string), for every row of docs. The decoded text is made from the ids.

    A null or empty text has no token and decodes to the empty string. Repeated rows each give a
    row, an empty table none. Other columns are ignored, whatever their names. Long texts are
    encoded whole, part by part.
    """
    session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (memory, make) = word_bpe(vocabulary), part_maker(vocabulary)
        for batch in gathered(batches, "text", CALL_BYTES):
            ids, ends = texts_as_ids(batch.column("text"), memory, make)
            each = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            back = bpe.decode(ids, ends)
            if digest:
                first = pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string())
                second = pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())
            else:
                first, second = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array([x.decode() for x in back], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), first, second], names=["doc_id", "n_tokens", *shape])

    shape = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    return doc_texts(docs).mapInArrow(lean(run), f"doc_id long, n_tokens long, {shape[0]} {'string' if digest else 'array<int>'}, {shape[1]} string")
