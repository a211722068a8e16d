"""Sections, size windows and truncation: Markdown in, pieces of Markdown out."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from .collect import counts
from .events import Event, inner_text, matching_end
from .filters import apply, content
from .markdown import block_markdown, to_markdown
from .options import Options, Truncate, Windows
from .parse import parse
from .words import Slugs, count_words, is_word, segments


def filtered(source: str, o: Options, offsets: bool = False) -> list[Event]:
    return apply(content(parse(source, o.syntax(), offsets)), o)


def top_level_blocks(events: list[Event]) -> list[tuple[int, int]]:
    """First and last event of each block that nothing contains."""
    out, i = [], 0
    while i < len(events):
        j = matching_end(events, i) if events[i].op == "start" else i
        out.append((i, j))
        i = j + 1
    return out


def bare_counts(events: list[Event]) -> tuple[int, int]:
    """Characters and words of filtered events; breaks count in code too."""
    text = "".join(e.text + " " if e.kind in ("text", "code") else " " for e in events if e.op == "leaf" and e.kind in ("text", "code", "soft_break", "hard_break"))
    return counts(text)


def truncate_events(events: list[Event], t: Truncate) -> str:
    marker = t.marker or ""
    chars = None if t.chars is None else max(0, t.chars - len(marker))
    words = None if t.words is None else max(0, t.words - count_words(marker))
    if t.at == "word":
        whole = to_markdown(events)
        if (t.chars is None or len(whole) + len(marker) <= t.chars) and (t.words is None or count_words(whole) + count_words(marker) <= t.words):
            return whole
        return whole[: fitting(segments(whole), chars, words)].rstrip() + marker
    kept: list[str] = []
    used_chars = used_words = 0
    dropped = False
    for a, b in top_level_blocks(events):
        block = block_markdown(events[a : b + 1])
        n, w = len(block.rstrip()) + (2 if kept else 0), count_words(block)
        if chars is not None and used_chars + n > chars or words is not None and used_words + w > words:
            dropped = True
            break
        kept.append(block)
        used_chars += n
        used_words += w
    text = "\n\n".join(kept)
    if not dropped or not text:
        return text
    return text.rstrip() + (f"\n\n{t.marker}" if t.marker is not None else "") + "\n"


def fitting(parts: list[str], chars: int | None, words: int | None) -> int:
    """How many characters of the segments fit both budgets."""
    n = w = 0
    for part in parts:
        if chars is not None and n + len(part) > chars or words is not None and w + is_word(part) > words:
            break
        n += len(part)
        w += is_word(part)
    return n


def truncate_markdown(source: str, t: Truncate, o: Options) -> str:
    return truncate_events(filtered(source, o), t) if source else ""


def chunks_by_heading(source: str, o: Options, t: Truncate | None = None) -> list[dict]:
    """A preamble if it says anything, then a section for every top-level heading, up to the next one
    of its level or higher; sections inside a section are in both."""
    if not source:
        return []
    events = filtered(source, o)
    slugs, heads, depth = Slugs(), [], 0
    for i, e in enumerate(events):
        if e.op == "end":
            depth -= 1
        if e.op == "start":
            if e.kind == "heading":
                j = matching_end(events, i)
                text = inner_text(events[i:j])
                slug = slugs.take(text)
                if not depth:
                    heads.append((i, j, e.level, text, slug or None))
            depth += 1

    def section(heading: str | None, level: int, slug: str | None, crumbs: list[str], part: list[Event]) -> dict:
        body = truncate_events(part, t) if t else to_markdown(part)
        row = {"heading": heading, "level": level, "id": slug, "breadcrumb": crumbs, "content": body, "character_count": None, "word_count": None}
        if o["statistics"]:
            again = Options.of().syntax()
            row["character_count"], row["word_count"] = bare_counts(parse(body, again, False) if t else part)
        return row

    out = []
    preamble = events[: heads[0][0]] if heads else events
    if any(e.op == "leaf" and e.kind in ("text", "code", "html", "inline_html", "inline_math", "display_math") for e in preamble):
        out.append(section(None, 0, None, [], preamble))
    above: list[tuple[int, str]] = []
    for k, (_, j, level, text, slug) in enumerate(heads):
        while above and above[-1][0] >= level:
            above.pop()
        end = next((a for a, _, other, _, _ in heads[k + 1 :] if other <= level), len(events))
        out.append(section(text, level, slug, [x for _, x in above], events[j + 1 : end]))
        above.append((level, text))
    return out


def block_windows(events: list[Event], w: Windows) -> list[str]:
    out: list[str] = []
    held, fresh = "", False  # fresh: holds more than the overlap of the window before
    for a, b in top_level_blocks(events):
        block = block_markdown(events[a : b + 1])
        joined = f"{held}\n\n{block}" if held else block
        over = w.chars is not None and len(joined) > w.chars or w.words is not None and count_words(held) + count_words(block) > w.words
        if held and over:
            out.append(held)
            seed = held[-w.overlap :] if w.overlap and w.overlap < len(held) else ""
            joined = f"{seed}\n\n{block}" if seed else block
        held, fresh = joined, True
    if held and fresh:
        out.append(held)
    return out


def word_windows(events: list[Event], w: Windows) -> list[str]:
    whole, out, i = to_markdown(events), [], 0
    parts = segments(whole)
    edges = [0, *accumulate(map(len, parts))]
    named = [0, *accumulate(map(is_word, parts))]  # words before each edge
    while i < len(parts):
        # the last edge within both budgets, one segment on at least
        end = len(parts)
        if w.chars is not None:
            end = min(end, bisect_right(edges, edges[i] + w.chars) - 1)
        if w.words is not None:
            end = min(end, bisect_right(named, named[i] + w.words) - 1)
        end = max(end, i + 1)
        out.append(whole[edges[i] : edges[end]])
        new = bisect_left(edges, max(0, edges[end] - w.overlap)) if w.overlap else end
        i = new if new > i else end
    return out


def chunks_by_size(source: str, w: Windows, o: Options) -> list[dict]:
    if not source:
        return []
    events = filtered(source, o)
    texts = block_windows(events, w) if w.at == "block" else word_windows(events, w)
    return [{"index": i, "content": x, "character_count": len(x.strip()) if o["statistics"] else None, "word_count": count_words(x) if o["statistics"] else None} for i, x in enumerate(texts)]


