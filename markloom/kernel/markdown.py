"""The Markdown sink: events as normalised Markdown."""

from __future__ import annotations

import re
import sys

from .events import Event, matching_end

DELIMITED = {"emphasis": "*", "strong": "**", "strikethrough": "~~", "superscript": "^", "subscript": "~"}
BLANKS = " \t"
MIGHT_BEGIN = re.compile(r"(?:[-+](?=[ \t]|$)|#{1,6}(?=[ \t]|$)|>|={3,}[ \t]*$|-{3,}[ \t]*$|~{3,})")
NUMBERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")


def escape_text(text: str, line_start: bool, table: bool) -> str:
    """Text such that it parses as the same text."""
    text = re.sub(r"([\\`*_\[\]<>])" if not table else r"([\\`*_\[\]<>|])", r"\\\1", text) if re.search(r"[\\`*_\[\]<>|]", text) else text
    text = re.sub(r"&(?=#?\w+;)", r"\\&", text)
    text = text.replace("~~", "\\~\\~")
    if line_start:
        if m := MIGHT_BEGIN.match(text):
            text = ("\\" + text) if m[0][0] != ">" else text
        elif m := NUMBERED.match(text):
            text = f"{m[1]}\\{text[len(m[1]):]}"
    return text


def tidy(events: list[Event]) -> list[Event]:
    """Moves blanks and breaks at the edges of delimited spans outside, drops spans left empty and
    breaks at block edges, until nothing changes."""
    while True:
        out: list[Event] = []
        changed = False
        i = 0
        while i < len(events):
            e, nxt = events[i], events[i + 1] if i + 1 < len(events) else None
            if e.op == "start" and e.kind in DELIMITED and nxt is not None:
                if nxt.op == "end" and nxt.kind == e.kind:
                    i += 2
                    changed = True
                    continue
                if nxt.kind in ("soft_break", "hard_break"):
                    out += [nxt, e]
                    i += 2
                    changed = True
                    continue
                if nxt.op == "leaf" and nxt.kind == "text" and nxt.text[:1].isspace():
                    body = nxt.text.lstrip()
                    out.append(nxt.but(text=nxt.text[: len(nxt.text) - len(body)]))
                    out.append(e)
                    if body:
                        out.append(nxt.but(text=body))
                    i += 2
                    changed = True
                    continue
            if e.op == "end" and e.kind in DELIMITED and out:
                last = out[-1]
                if last.kind in ("soft_break", "hard_break"):
                    out[-1:] = [e, last]
                    i += 1
                    changed = True
                    continue
                if last.op == "leaf" and last.kind == "text" and last.text[-1:].isspace():
                    body = last.text.rstrip()
                    out[-1:] = ([last.but(text=body)] if body else []) + [e, last.but(text=last.text[len(body) :])]
                    i += 1
                    changed = True
                    continue
            if e.kind in ("soft_break", "hard_break") and (not out or out[-1].op == "start" and out[-1].kind in ("paragraph", "heading", "table_cell", "list_item") or nxt is not None and nxt.op == "end" and nxt.kind in ("paragraph", "heading", "table_cell")):
                i += 1
                changed = True
                continue
            out.append(e)
            i += 1
        if not changed:
            return out
        events = out


def merged(events: list[Event]) -> list[Event]:
    """Neighbouring text events as one, so that escapes see the whole run."""
    out: list[Event] = []
    for e in events:
        if out and e.op == out[-1].op == "leaf" and e.kind == out[-1].kind == "text":
            out[-1] = out[-1].but(text=out[-1].text + e.text)
        else:
            out.append(e)
    return out


class Writer:
    def __init__(self) -> None:
        self.notes: list[str] = []

    def blocks(self, events: list[Event], tight: bool = False) -> str:
        """Blocks joined by blank lines, or by line ends in tight list items."""
        parts: list[str] = []
        i, run = 0, []

        def flush() -> None:
            if run:
                if body := self.inline(run):
                    parts.append(body)
                run.clear()

        block_kinds = ("paragraph", "heading", "blockquote", "code_block", "html_block", "list", "ordered_list", "footnote_definition", "table", "definition_list", "metadata_block")
        previous = ""
        while i < len(events):
            e = events[i]
            if e.op == "start" and e.kind in block_kinds:
                flush()
                j = matching_end(events, i)
                body = self.block(e, events[i + 1 : j])
                if body or e.kind != "paragraph":
                    if parts and previous in ("list", "ordered_list") and e.kind in ("code_block",) and not e.fenced:
                        parts.append("<!-- -->")
                    parts.append(body)
                    previous = e.kind
                i = j
            elif e.op == "leaf" and e.kind == "rule":
                flush()
                parts.append("---")
                previous = "rule"
            elif e.op == "leaf" and e.kind == "html":
                flush()
                parts.append(e.text.rstrip("\n"))
            else:
                run.append(e)
            i += 1
        flush()
        return ("\n" if tight else "\n\n").join(parts)

    def block(self, e: Event, inner: list[Event]) -> str:
        kind = e.kind
        if kind == "paragraph":
            return self.inline(inner)
        if kind == "heading":
            marks = [f"#{e.id}"] if e.id else []
            marks += [f".{c}" for c in e.classes] + [k if v is None else f"{k}={v}" for k, v in e.attrs]
            body = re.sub(r"(?:(?<=[ \t])|^)(#+)$", r"\\\1", self.inline(inner, heading=True))
            return " ".join(x for x in ("#" * e.level, body, f"{{ {' '.join(marks)} }}" if marks else "") if x)
        if kind == "blockquote":
            body = self.blocks(inner)
            head = f"[!{e.alert.upper()}]\n" if e.alert else ""
            return "\n".join(f" > {x}" if x else " >" for x in (head + body).split("\n"))
        if kind == "code_block":
            text = "".join(x.text for x in inner)
            if not e.fenced:
                return "\n".join(f"    {x}" if x else "" for x in text.rstrip("\n").split("\n"))
            fence = "`" * max(3, *(len(m) + 1 for m in re.findall(r"`{3,}", text)), 3)
            if "`" in e.lang:
                fence = "~" * max(3, *(len(m) + 1 for m in re.findall(r"~{3,}", text)), 3)
            return f"{fence}{e.lang}\n{text}{'' if not text or text.endswith(chr(10)) else chr(10)}{fence}"
        if kind == "html_block":
            return self.html_block(inner)
        if kind in ("list", "ordered_list"):
            return self.list(e, inner)
        if kind == "footnote_definition":
            body = self.blocks(inner)
            return f"[^{e.label}]: " + "\n".join(x if k == 0 or not x else f"    {x}" for k, x in enumerate(body.split("\n")))
        if kind == "table":
            return self.table(e, inner)
        if kind == "definition_list":
            return self.definitions(inner)
        return "---\n" + "".join(x.text for x in inner).rstrip("\n") + "\n---"

    def html_block(self, inner: list[Event]) -> str:
        """Live HTML as it is; suppressed HTML as a paragraph of its trimmed lines."""
        if any(x.kind == "html" for x in inner):
            return "".join(x.text for x in inner).rstrip("\n")
        lines = [x.strip() for x in "".join(y.text for y in inner).split("\n")]
        return "\n".join(escape_text(x, True, False) for x in lines if x)

    def list(self, e: Event, inner: list[Event]) -> str:
        items, i, loose = [], 0, any(x.op == "start" and x.kind == "paragraph" for x in self.top(inner))
        number = e.list_start
        while i < len(inner):
            j = matching_end(inner, i)
            mark = "* " if number is None else f"{number}. "
            body = self.blocks(inner[i + 1 : j], tight=not loose)
            items.append(mark.rstrip() if not body else mark + "\n".join(x if k == 0 or not x else " " * len(mark) + x for k, x in enumerate(body.split("\n"))))
            i = j + 1
        return ("\n\n" if loose else "\n").join(items)

    @staticmethod
    def top(inner: list[Event]) -> list[Event]:
        """The events directly inside the items of a list."""
        out, depth = [], 0
        for x in inner:
            if x.op == "end":
                depth -= 1
            if depth == 1:
                out.append(x)
            if x.op == "start":
                depth += 1
        return out

    def table(self, e: Event, inner: list[Event]) -> str:
        rows: list[str] = []
        i = 0
        while i < len(inner):
            j = matching_end(inner, i)
            cells, k = [], i + 1
            while k < j:
                end = matching_end(inner, k)
                cells.append(self.inline(inner[k + 1 : end], table=True))
                k = end + 1
            rows.append("|" + "|".join(cells) + "|")
            if len(rows) == 1:
                rows.append("|" + "|".join({"left": ":--", "center": ":-:", "right": "--:"}.get(a, "---") for a in e.align) + "|")
            i = j + 1
        return "\n".join(rows)

    def definitions(self, inner: list[Event]) -> str:
        out, i = [], 0
        while i < len(inner):
            j = matching_end(inner, i)
            if inner[i].kind == "definition_list_title":
                out.append(("\n" if out else "") + self.inline(inner[i + 1 : j]))
            else:
                body = self.blocks(inner[i + 1 : j])
                out.append(": " + "\n".join(x if k == 0 or not x else f"  {x}" for k, x in enumerate(body.split("\n"))))
            i = j + 1
        return "\n".join(out)

    def inline(self, events: list[Event], table: bool = False, heading: bool = False) -> str:
        events = merged(tidy(events))
        while events and events[-1].kind in ("soft_break", "hard_break"):
            events.pop()
        out: list[str] = []
        i, fresh = 0, True
        while i < len(events):
            e = events[i]
            if e.op == "leaf":
                if e.kind == "text":
                    out.append(escape_text(e.text, fresh and not table and not heading, table))
                elif e.kind == "code":
                    out.append(self.code(e.text, table))
                elif e.kind in ("html", "inline_html"):
                    out.append(e.text)
                elif e.kind in ("soft_break", "hard_break"):
                    out.append(" " if table or heading else "\n" if e.kind == "soft_break" else "  \n")
                elif e.kind == "footnote_reference":
                    out.append(f"[^{e.label}]")
                elif e.kind == "task_list_marker":
                    out.append("[x] " if e.checked else "[ ] ")
                elif e.kind in ("inline_math", "display_math"):
                    mark = "$" if e.kind == "inline_math" else "$$"
                    out.append(mark + e.text + mark)
                fresh = e.kind in ("soft_break", "hard_break")
                i += 1
                continue
            j = matching_end(events, i)
            inner = events[i + 1 : j]
            if e.kind in DELIMITED:
                mark = DELIMITED[e.kind]
                if mark == "*" and out and out[-1].endswith("*") and not out[-1].endswith("\\*"):
                    mark = "_"
                out.append(mark + self.inline(inner, table, heading) + mark)
            elif e.kind in ("link", "image"):
                out.append(self.link(e, inner, table, heading))
            else:
                out.append(self.inline(inner, table, heading))
            fresh = False
            i = j + 1
        body = "".join(out)
        return body.strip(BLANKS) if table or heading else "\n".join(x if x.endswith("  ") and k < body.count("\n") else x.rstrip(BLANKS) for k, x in enumerate(body.lstrip(BLANKS).split("\n")))

    @staticmethod
    def code(text: str, table: bool) -> str:
        ticks = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
        pad = " " if text[:1] == "`" or text[-1:] == "`" or text[:1] == text[-1:] == " " and text.strip() else ""
        body = text.replace("|", "\\|") if table else text
        return f"{ticks}{pad}{body}{pad}{ticks}"

    def link(self, e: Event, inner: list[Event], table: bool, heading: bool) -> str:
        if e.kind == "link" and e.link_type in ("autolink", "email"):
            return f"<{e.dest}>"
        body = self.inline(inner, table, heading)
        if e.link_type == "wikilink":
            return f"[[{e.dest}]]" if body == e.dest else f"[[{e.dest}|{body}]]"
        dest = e.dest or ""
        if not dest or re.search(r"[\s()<>]", dest):
            dest = "<" + re.sub(r"([<>\\])", r"\\\1", dest) + ">" if dest else "<>" if e.title else ""
        name = ' "' + e.title.replace("\\", "\\\\").replace('"', '\\"') + '"' if e.title else ""
        return f"{'!' if e.kind == 'image' else ''}[{body}]({dest}{name})"


def to_markdown(events: list[Event]) -> str:
    depth = deepest = 0
    for e in events:
        depth += (e.op == "start") - (e.op == "end")
        deepest = max(deepest, depth)
    # a level takes a few calls, all of them Python's own, which need no place on the machine's stack
    limit = sys.getrecursionlimit()
    if 4 * deepest < limit // 2:
        return Writer().blocks(events)
    sys.setrecursionlimit(limit + 4 * deepest)
    try:
        return Writer().blocks(events)
    finally:
        sys.setrecursionlimit(limit)


def block_markdown(events: list[Event]) -> str:
    """One top-level block for joining with blank lines."""
    return to_markdown(events).strip("\n")
