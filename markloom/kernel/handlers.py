"""Per-element handlers: a tree over events, visited children first, written back to events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .events import Event
from .filters import after, before
from .html import to_html
from .options import Options
from .parse import parse


@dataclass
class Element:
    """What a handler sees. Fields that may be set: html, markdown, dest, title, level, id, deleted."""

    event: Event
    kind: str
    depth: int
    parent: Element | None = None
    children: list[Element] = field(default_factory=list)
    source: str = ""
    html: str | None = None
    markdown: str | None = None
    dest: str | None = None
    title: str | None = None
    id: str | None = None
    deleted: bool = False
    _level: int | None = None

    @property
    def level(self) -> int | None:
        return self._level

    @level.setter
    def level(self, n: int) -> None:
        self._level = max(1, min(6, int(n)))

    @property
    def text(self) -> str:
        """A leaf's own text; a container's is that of its children joined. Breaks add nothing."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.event.op == "start":
                todo += reversed(x.children)
            elif x.kind not in ("soft_break", "hard_break"):
                out.append(x.event.text)
        return "".join(out)

    @property
    def lang(self) -> str | None:
        return self.event.lang

    @property
    def byte_range(self) -> tuple[int, int]:
        return self.event.start, self.event.end

    @property
    def parent_kind(self) -> str | None:
        return self.parent.kind if self.parent else None

    @property
    def ancestor_kinds(self) -> list[str]:
        """The kinds of all containers around, the nearest first."""
        out, up = [], self.parent
        while up:
            out.append(up.kind)
            up = up.parent
        return out

    def children_of(self, kind: str) -> list[Element]:
        return [c for c in self.children if c.kind == kind]

    def delete(self) -> None:
        self.deleted = True


Handler = Callable[[Element], object]


class Handlers:
    """Handlers by kind, run in the order in which they were added."""

    def __init__(self) -> None:
        self.by_kind: dict[str, list[Handler]] = {}

    def on(self, kind: str, handler: Handler) -> Handlers:
        self.by_kind.setdefault(kind, []).append(handler)
        return self


def tree(events: list[Event], source: str) -> list[Element]:
    raw = source.encode()
    top: list[Element] = []
    open_: list[Element] = []
    for e in events:
        if e.op == "end":
            open_.pop()
            continue
        parent = open_[-1] if open_ else None
        kind = "html" if e.kind == "inline_html" else e.kind
        element = Element(e, kind, len(open_), parent, source=raw[e.start : e.end].decode("utf-8", "replace"), dest=e.dest, title=e.title, id=e.id, _level=e.level)
        (parent.children if parent else top).append(element)
        if e.op == "start":
            open_.append(element)
    return top


def visit(elements: list[Element], handlers: Handlers) -> Iterator[tuple[Element, object]]:
    """Children before their parent; yields what handlers return."""
    todo = [(x, False) for x in reversed(elements)]
    while todo:
        element, ready = todo.pop()
        if not ready:
            todo.append((element, True))
            todo += [(x, False) for x in reversed(element.children)]
            continue
        for handler in handlers.by_kind.get(element.kind, ()):
            yield element, handler(element)


def flat(elements: list[Element], o: Options) -> list[Event]:
    """Back to events: deletion first, then html, then markdown, then changed fields. An ordered list
    that is rebuilt starts at 1."""
    out: list[Event] = []
    todo: list[Element | Event] = list(reversed(elements))
    while todo:
        x = todo.pop()
        if isinstance(x, Event):
            out.append(x)
        elif x.deleted:
            continue
        elif x.html is not None:
            out.append(Event("leaf", "inline_html", x.html))
        elif x.markdown is not None:
            out += before(parse(x.markdown, o.syntax()), o)
        elif x.event.op == "leaf":
            out.append(x.event)
        else:
            start = x.event.but(dest=x.dest, title=x.title, id=x.id, level=x._level, list_start=1 if x.event.kind == "ordered_list" else x.event.list_start)
            out.append(start)
            todo += [start.but(op="end"), *reversed(x.children)]
    return out


def walk(source: str, handlers: Handlers, o: Options) -> list[tuple[Element, object]]:
    return list(visit(tree(before(parse(source, o.syntax()), o), source), handlers))


def to_html_with(source: str, handlers: Handlers, o: Options) -> str:
    top = tree(before(parse(source, o.syntax()), o), source)
    for _ in visit(top, handlers):
        pass
    return to_html(after(flat(top, o), o))


