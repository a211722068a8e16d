"""Transcripts to canonical turns by a hidden Markov model (operator 3).

A transcript is a sequence of lines. Its hidden states say who speaks in a line and whether a turn
begins there; speaker markers and line features are what is seen. Viterbi finds the most probable
states, and turns are rendered under one header each. The header replaces the marker where a turn
begins; lines that go on keep what looks like one, and the blank lines before them.

A conversation may be as long as a third of the table. Rows are dealt in order to parts of bounded
size, so a long conversation spans many. For one that crosses an edge, a part first gives the best
scores between all states at its ends (a small matrix); these are chained over the parts, forward
for scores and backward for states, and each part then decodes with the scores it begins with and
the state it ends in. The result is that of one pass over the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, stored

ROLES = ("system", "user", "assistant")
#: Rows of a part.
PART_ROWS = 20_000
#: Names under which speakers go.
NAMES = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "question": 1, "q": 1, "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2}
MARKER = re.compile(rf"\s*(?:(?:#{{1,6}}\s*|\*\*)?(?P<a>{'|'.join(NAMES)})(?:\*\*)?\s*:(?:\*\*)?|<\|(?P<b>{'|'.join(NAMES)})\|>|\[(?P<c>{'|'.join(NAMES)})\]:?)[ \t]*", re.IGNORECASE)
KEY = ["__c0", "__c1", "__t0", "__t1", "__h", "__u"]

#: States: 2 * role says that a turn of the role begins, 2 * role + 1 that it goes on.
STATES = 2 * len(ROLES)
#: Probabilities. First lines by role; after a line of a role: that it goes on, else who begins.
FIRST = (0.25, 0.65, 0.10)
GOES_ON = 0.75
NEXT = ((0.02, 0.90, 0.08), (0.01, 0.07, 0.92), (0.02, 0.93, 0.05))
#: A marker of the own role, none, another role's: where a turn begins, and where it goes on.
MARKED = ((0.80, 0.19, 0.005), (0.004, 0.988, 0.004))
#: A blank line before the line; a question mark at its end, by role; a lower-case first letter.
BLANK = (0.60, 0.05)
ASKS = (0.02, 0.20, 0.05)
LOWER = (0.05, 0.25)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities: first states, transitions, and emissions by feature code."""
    first = np.full(STATES, -np.inf)
    first[::2] = np.log(FIRST)
    move = np.full((STATES, STATES), -np.inf)
    for s in range(STATES):
        move[s, s // 2 * 2 + 1] = np.log(GOES_ON)
        move[s, ::2] = np.log((1 - GOES_ON) * np.array(NEXT[s // 2]))
    seen = np.zeros((4, 2, 2, 2, STATES))  # marker (0 none, else role + 1), blank, asks, lower
    for at in np.ndindex(seen.shape):
        marker, blank, asks, lower, state = at
        role, on = divmod(state, 2)
        p = MARKED[on][1 if marker == 0 else 0 if marker == role + 1 else 2]
        for q, yes in ((BLANK[on], blank), (ASKS[role], asks), (LOWER[on], lower)):
            p *= q if yes else 1 - q
        seen[at] = np.log(p)
    return first, move, seen.reshape(-1, STATES)


FIRST_LOG, MOVE, SEEN = tables()


def observed(text: str | None) -> tuple[list[tuple[int, str, str]], list[int], int]:
    """The lines of a piece (blank lines before it, the line, the line without its marker), their
    feature codes, and the blank lines at the end. Blank lines are no lines of their own; they tell
    something about the next."""
    lines, codes, blank = [], [], 0
    for line in (text or "").removesuffix("\n").split("\n") if text else ():
        if not line.strip():
            blank += 1
            continue
        m = MARKER.match(line)
        body = line[m.end() :] if m else line
        marker = 1 + NAMES[(m["a"] or m["b"] or m["c"]).lower()] if m else 0
        codes.append(((marker * 2 + (blank > 0)) * 2 + body.rstrip().endswith("?")) * 2 + body[:1].islower())
        lines.append((blank, line, body))
        blank = 0
    return lines, codes, blank


def blanks_after(pieces: list[tuple[list, list[int], int]], before: int = 0) -> int:
    """Blank lines since the last line of observed pieces, or since `before` of them."""
    for lines, _, end in pieces:
        before = end if lines else before + end
    return before


def advance(score: np.ndarray, codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores after the lines, and for each line and state the best state before it."""
    back = np.zeros((len(codes), STATES), np.int8)
    for i, c in enumerate(codes):
        ways = score[:, None] + MOVE
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + SEEN[c]
    return score, back


def begin(codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """advance() from the start of a conversation."""
    if not codes:
        return FIRST_LOG, np.zeros((0, STATES), np.int8)
    score, back = advance(FIRST_LOG + SEEN[codes[0]], codes[1:])
    return score, np.concatenate([np.zeros((1, STATES), np.int8), back])


def transfer(codes: list[int]) -> np.ndarray:
    """Best scores from each state before the lines to each state after."""
    out = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for c in codes:
        out = (out[:, :, None] + MOVE[None]).max(axis=1) + SEEN[c]
    return out


def backtrack(back: np.ndarray, state: int) -> list[int]:
    states = []
    for row in back[::-1]:
        states.append(state)
        state = int(row[state])
    return states[::-1]


def runs(part: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A part in order, and the rows of each of its conversations."""
    part = part.sort_by([(k, "ascending") for k in KEY])
    a, b = (part.column(k).to_numpy() for k in KEY[:2])
    cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    edges = [0, *cuts.tolist(), part.num_rows]
    return part, list(zip(edges, edges[1:], strict=False))


def edges(key: tuple, part: pa.Table) -> pa.Table:
    """What the chain over parts needs of a part: its first and last conversation, and for both the
    scores of beginning there and of passing through."""
    part, spans = runs(part)
    texts = part.column("__text")
    out: dict[str, list] = {"part": [key[0].as_py()], "single": [len(spans) == 1]}
    for name, (start, stop) in (("first", spans[0]), ("last", spans[-1])):
        pieces = [observed(t) for t in texts.slice(start, stop - start).to_pylist()]
        codes = [c for _, own, _ in pieces for c in own]
        out[f"{name}_c0"], out[f"{name}_c1"] = [part.column(KEY[0])[start].as_py()], [part.column(KEY[1])[start].as_py()]
        out[f"{name}_lines"], out[f"{name}_blanks"] = [len(codes)], [blanks_after(pieces)]
        out[f"{name}_begin"], out[f"{name}_pass"] = [begin(codes)[0].tolist()], [transfer(codes).ravel().tolist()]
    return pa.table(out).cast(pa.schema([(n, t) for n, t in EDGE_TYPES]))


EDGE_TYPES = [("part", pa.int32()), ("single", pa.bool_())] + [(f"{e}_{n}", t) for e in ("first", "last") for n, t in (("c0", pa.int32()), ("c1", pa.int64()), ("lines", pa.int64()), ("blanks", pa.int64()), ("begin", pa.list_(pa.float64())), ("pass", pa.list_(pa.float64())))]
EDGES = "part int, single boolean, " + ", ".join(f"{e}_c0 int, {e}_c1 long, {e}_lines long, {e}_blanks long, {e}_begin array<double>, {e}_pass array<double>" for e in ("first", "last"))


def chain(rows: list[dict]) -> dict[int, tuple[np.ndarray | None, bool, int, int | None]]:
    """For each part that a conversation enters or leaves: (scores it begins with, whether lines came
    before, blank lines since the last of them, the state its last line is in). rows: edges() in order of the parts."""
    same = [False][: len(rows)] + [(a["last_c0"], a["last_c1"]) == (b["first_c0"], b["first_c1"]) for a, b in zip(rows, rows[1:], strict=False)]
    entry: list[tuple[np.ndarray | None, bool, int]] = []
    after: tuple[np.ndarray, bool, int] = (FIRST_LOG, False, 0)

    def through(row: dict, edge: str, given: tuple[np.ndarray, bool, int] | None) -> tuple[np.ndarray, bool, int]:
        lines, blanks = row[f"{edge}_lines"], row[f"{edge}_blanks"]
        if given is None or not given[1]:
            return np.array(row[f"{edge}_begin"]), lines > 0, blanks
        return (given[0][:, None] + np.array(row[f"{edge}_pass"]).reshape(STATES, STATES)).max(axis=0), True, blanks if lines else given[2] + blanks

    for row, goes_on in zip(rows, same, strict=True):
        given = after if goes_on else None
        entry.append(given if given else (None, False, 0))
        after = through(row, "last", given if row["single"] else None)
    exits: list[int | None] = [None] * len(rows)
    for p in range(len(rows) - 1, 0, -1):
        if not same[p] or not entry[p][1]:
            continue
        scores, row = entry[p][0], rows[p]
        last = exits[p] if row["single"] else None
        if row["first_lines"]:
            ways = scores[:, None] + np.array(row["first_pass"]).reshape(STATES, STATES)
            last = int(ways.max(axis=0).argmax()) if last is None else last
            exits[p - 1] = int(ways[:, last].argmax())
        else:
            exits[p - 1] = int(scores.argmax()) if last is None else last
    return {row["part"]: (*e, x) for row, e, x in zip(rows, entry, exits, strict=True) if e[1] or x is not None}


def decode(known: dict[int, tuple[np.ndarray | None, bool, int, int | None]]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table) -> pa.Table:
        scores, entered, carried, leaves = known.get(key[0].as_py(), (None, False, 0, None))
        part, spans = runs(part)
        pieces = [observed(t) for t in part.column("__text").to_pylist()]
        roles, starts, rendered = [], [], []
        for i, (start, stop) in enumerate(spans):
            codes = [c for _, own, _ in pieces[start:stop] for c in own]
            score, back = advance(scores, codes) if i == 0 and entered else begin(codes)
            state = leaves if leaves is not None and i == len(spans) - 1 else int(score.argmax())
            states = iter(backtrack(back, state))
            blanks = carried if i == 0 and entered else 0
            for piece in pieces[start:stop]:
                lines = piece[0]
                own = [next(states) for _ in lines]
                roles.append([ROLES[s // 2] for s in own])
                starts.append([j for j, s in enumerate(own) if s % 2 == 0])
                gaps = [n if j else n + blanks for j, (n, _, _) in enumerate(lines)]
                rendered.append("".join(f"<|{ROLES[s // 2]}|>\n{body}\n" if s % 2 == 0 else "\n" * n + f"{line}\n" for n, (_, line, body), s in zip(gaps, lines, own, strict=True)))
                blanks = blanks_after([piece], blanks)
        out = part.select(["conv_id", "turn"])
        for name, x, kind in (("line_roles", roles, pa.list_(pa.string())), ("turn_starts", starts, pa.list_(pa.int32())), ("rendered", rendered, pa.string())):
            out = out.append_column(name, pa.array(x, kind))
        return out

    return run


def canonical_turns(transcripts: DataFrame) -> DataFrame:
    """For every row of transcripts (conv_id, turn, text: pieces of raw transcripts, in order of
    turn): conv_id, turn, line_roles (who speaks in each line that is not blank), turn_starts
    (indexes of lines where a turn begins), rendered (the piece in canonical form). The pieces of a
    conversation, joined in order, are its canonical transcript.

    Null conv_ids are one conversation. Null turns come first; rows equal in conv_id and turn come
    in the order of a hash of the text. A null, empty or blank text has no line and renders to the
    empty string. An empty table gives no rows; other columns are ignored."""
    session_of(transcripts)
    rows = transcripts.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("text").cast("string").alias("__text"),
    )
    no = lambda c: F.col(c).isNotNull().cast("int")
    rows = rows.select("*", no("conv_id").alias("__c0"), F.coalesce("conv_id", F.lit(0)).alias("__c1"), no("turn").alias("__t0"), F.coalesce("turn", F.lit(0)).alias("__t1"), F.xxhash64("__text").alias("__h"), F.monotonically_increasing_id().alias("__u"))
    rows = stored(rows, "pieces")
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = stored(rows.repartitionByRange(parts, *KEY).withColumn("__part", F.spark_partition_id()), "parts")
    # one row for each part, whatever it holds
    found = dealt.groupBy("__part").applyInArrow(edges, EDGES).orderBy("part").collect()
    known = chain([r.asDict() for r in found])
    return dealt.groupBy("__part").applyInArrow(decode(known), "conv_id long, turn long, line_roles array<string>, turn_starts array<int>, rendered string")


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations as raw transcripts: by a hash of conv_id and turn, a turn has a marker in one of
    four styles, or none but a blank line before it."""
    role = F.coalesce("role", F.lit("user"))
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))
    mark = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n"))).when(style == 2, F.concat(F.lit("<|"), role, F.lit("|> "))).when(style == 3, F.concat(F.lit("["), F.upper(role), F.lit("] "))).otherwise("\n")
    return conversations.select("conv_id", "turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))
