"""From a source string to its event list."""

from __future__ import annotations

import re
from bisect import bisect_left

from .blocks import Block, Blocks, split_row
from .events import Event
from .inlines import Inlines, located, marked_of
from .syntax import Syntax

TASK = re.compile(r"\[([ xX\t\n])\](?=[ \t\n]|$)[ \t]?")


class Walk:
    def __init__(self, blocks: Blocks, syntax: Syntax):
        self.blocks, self.syntax, self.marks = blocks, syntax, marked_of(syntax)
        self.out: list[Event] = []
        # what is still to do, the next last: an event, a block with whether it stands tight, a list's
        # item, or a leaf's lines
        todo: list = [(child, False) for child in reversed(blocks.root.children)]
        while todo:
            step = todo.pop()
            if isinstance(step, Event):
                self.out.append(step)
            elif isinstance(step, list):
                self.inline(step)
            else:
                block, tight = step
                todo += reversed(self.item(block, tight) if block.kind == "list_item" else self.block(block, tight))

    def inline(self, lines: list[tuple[int, str]]) -> None:
        """The inline events of a leaf's lines; blanks at line ends belong to breaks."""
        if not lines:
            return
        text = "\n".join([x for _, x in lines])
        if not self.marks.search(text):
            self.prose(lines)
            return
        body = text.rstrip(" \t")
        events = Inlines(body, self.syntax, self.blocks.references, self.blocks.footnotes).events()
        self.out += located(events, lines)

    def prose(self, lines: list[tuple[int, str]]) -> None:
        """Lines without any mark: texts and breaks."""
        put, last = self.out.append, len(lines) - 1
        for k, (at, x) in enumerate(lines):
            body = x.rstrip(" \t")
            if body:
                put(Event("leaf", "text", body, start=at, end=at + len(body)))
            if k < last:
                put(Event("leaf", "hard_break" if x.endswith("  ") else "soft_break", start=at + len(x), end=at + len(x) + 1))

    def block(self, b: Block, tight: bool) -> list:
        """Writes what comes first of a block; gives the steps for the rest."""
        put, kind, span = self.out.append, b.kind, {"start": b.start, "end": b.end}
        if kind == "paragraph":
            if not tight:
                put(Event("start", kind, **span))
            self.inline(b.lines)
            if not tight:
                put(Event("end", kind, **span))
        elif kind == "heading":
            put(Event("start", kind, level=b.level, id=b.id, classes=b.classes, attrs=b.attrs, **span))
            self.inline(b.lines)
            put(Event("end", kind, level=b.level, **span))
        elif kind == "rule":
            put(Event("leaf", kind, **span))
        elif kind == "code_block":
            put(Event("start", kind, lang=b.data["info"] if b.fenced else "", fenced=b.fenced, **span))
            if b.lines:
                text = "".join(f"{x}\n" for _, x in b.lines)
                put(Event("leaf", "text", text, start=b.lines[0][0], end=b.lines[-1][0] + len(b.lines[-1][1])))
            put(Event("end", kind, fenced=b.fenced, **span))
        elif kind == "html_block":
            put(Event("start", kind, **span))
            for at, x in b.lines:
                put(Event("leaf", "html", f"{x}\n", start=at, end=at + len(x)))
            put(Event("end", kind, **span))
        elif kind == "metadata_block":
            put(Event("start", kind, **span))
            put(Event("leaf", "text", b.lines[0][1], start=b.lines[0][0], end=b.lines[0][0] + len(b.lines[0][1])))
            put(Event("end", kind, **span))
        elif kind == "table":
            self.table(b, span)
        elif kind in ("list", "ordered_list"):
            put(Event("start", kind, list_start=b.data["start"], **span))
            return [*((item, not b.loose) for item in b.children), Event("end", kind, **span)]
        elif kind == "definition_list":
            put(Event("start", kind, **span))
            steps: list = []
            for child in b.children:
                own = {"start": child.start, "end": child.end}
                steps.append(Event("start", child.kind, **own))
                if child.kind == "definition_list_title":
                    steps.append(child.lines)
                else:
                    loose = any(Blocks.ends_blank(x) for x in child.children[:-1])
                    steps += [(x, not loose) for x in child.children]
                steps.append(Event("end", child.kind, **own))
            return [*steps, Event("end", kind, **span)]
        else:
            label = b.data.get("label")
            put(Event("start", kind, alert=b.alert, label=label, **span))
            return [*((child, False) for child in b.children), Event("end", kind, alert=b.alert, label=label, **span)]
        return []

    def item(self, b: Block, tight: bool) -> list:
        """As block(), for a list's item."""
        span = {"start": b.start, "end": b.end}
        self.out.append(Event("start", "list_item", **span))
        first = b.children[0] if b.children else None
        task, steps = None, []
        if self.syntax.tasklists and first is not None and first.kind == "paragraph" and first.lines and (m := TASK.match(first.lines[0][1])):
            at, text = first.lines[0]
            if text[m.end() :].strip() or len(first.lines) > 1:
                task = Event("leaf", "task_list_marker", checked=m[1] in "xX", start=at, end=at + 3)
                first.lines[0] = (at + m.end(), text[m.end() :])
        for i, child in enumerate(b.children):
            if i == 0 and task:
                own = {"start": child.start, "end": child.end}
                steps += [task, child.lines] if tight else [Event("start", "paragraph", **own), task, child.lines, Event("end", "paragraph", **own)]
            else:
                steps.append((child, tight))
        return [*steps, Event("end", "list_item", **span)]

    def table(self, b: Block, span: dict) -> None:
        put, width = self.out.append, len(b.align)
        put(Event("start", "table", align=b.align, **span))
        for r, (at, line) in enumerate(b.lines):
            kind = "table_row" if r else "table_head"
            own = {"start": at, "end": at + len(line)}
            put(Event("start", kind, **own))
            cells = split_row(line)
            for k in range(width):
                offset, text = cells[k] if k < len(cells) else (len(line), "")
                place = {"start": at + offset, "end": at + offset + len(text)}
                align = b.align[k]
                put(Event("start", "table_cell", align=[align], **place))
                # a pipe that was escaped for the table is a plain one to what is inside
                self.inline([(at + offset, re.sub(r"\\\|", "|", text))])
                put(Event("end", "table_cell", align=[align], **place))
            put(Event("end", kind, **own))
        put(Event("end", "table", align=b.align, **span))


WIDE = re.compile(r"[^\x00-\x7f]")


def parse(source: str, syntax: Syntax = Syntax(), offsets: bool = True) -> list[Event]:
    """The events of a source, their ranges in bytes of its UTF-8 (left in characters if no one asks
    for offsets)."""
    if not source:
        return []
    out = Walk(Blocks(source, syntax), syntax).out
    if offsets and not source.isascii():
        # what the wide characters up to a place add to it
        places, more, total = [], [0], 0
        for m in WIDE.finditer(source):
            places.append(m.start())
            total += 1 if m[0] < "\u0800" else 2 if m[0] < "\U00010000" else 3
            more.append(total)
        for e in out:
            e.start, e.end = e.start + more[bisect_left(places, e.start)], e.end + more[bisect_left(places, e.end)]
    return out
