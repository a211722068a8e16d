"""The plain-text sink."""

from __future__ import annotations

from .events import Event

#: Containers whose text is gathered apart before it is placed.
GATHERED = {"blockquote", "code_block", "table_cell", "link", "image", "footnote_definition", "metadata_block"}


def prefix_lines(text: str, prefix: str) -> str:
    """Every line with the prefix; empty lines with the bare prefix."""
    return "\n".join(prefix + x if x else prefix.rstrip() for x in text.split("\n"))


def to_plain_text(events: list[Event]) -> str:
    stack: list[list[str]] = [[]]
    lists: list[int | None] = []  # the next number, None for bullets
    cells: list[str] = []
    notes: list[tuple[str, str]] = []

    def say(text: str) -> None:
        if text:
            stack[-1].append(text)

    def ends(mark: str) -> bool:
        tail = ""
        for part in reversed(stack[-1]):
            tail = part + tail
            if len(tail) >= len(mark):
                break
        return tail.endswith(mark)

    def gap(lines: int) -> None:
        if any(stack[-1]):
            while not ends("\n" * lines):
                say("\n")

    for e in events:
        kind = e.kind
        if e.op == "leaf":
            if kind == "soft_break":
                say(" ")
            elif kind == "hard_break":
                say("\n")
            elif kind == "rule":
                gap(2)
                say("---\n\n")
            elif kind == "footnote_reference":
                say(f"[{e.label}]")
            elif kind != "task_list_marker":
                say(e.text)
        elif e.op == "start":
            if kind in GATHERED:
                stack.append([])
            elif kind in ("list", "ordered_list"):
                gap(1 if lists else 2)
                lists.append(e.list_start)
            elif kind == "list_item":
                gap(1)
                number = lists[-1] if lists else None
                say("  " * (len(lists) - 1) + ("- " if number is None else f"{number}. "))
                if number is not None:
                    lists[-1] = number + 1
            elif kind in ("table_head", "table_row"):
                cells = []
        elif kind in GATHERED:
            body = "".join(stack.pop())
            if kind == "blockquote":
                gap(2)
                say(prefix_lines(body.rstrip("\n"), "> ") + "\n\n")
            elif kind == "code_block":
                gap(2)
                say(body.rstrip("\n") + "\n\n")
            elif kind == "table_cell":
                cells.append(body)
            elif kind == "link":
                opener = matching_start(events, e)
                dest = opener.dest or ""
                say(body if body == dest else f"{body} ({dest})")
            elif kind == "image":
                say(f"{body} ({matching_start(events, e).dest or ''})")
            elif kind == "footnote_definition":
                notes.append((e.label or "", body.strip()))
        elif kind in ("paragraph", "heading"):
            say("\n\n")
        elif kind in ("list", "ordered_list"):
            lists.pop()
            gap(1)
            if not lists:
                say("\n")
        elif kind == "list_item":
            say("\n")
        elif kind in ("table_head", "table_row"):
            say("\t".join(cells) + ("\n\n" if kind == "table_head" else "\n"))
        elif kind == "table":
            say("\n")
    if notes:
        gap(2)
        say("".join(f"[{label}]: {body}\n" for label, body in notes))
    text = "".join(stack[0]).rstrip("\n")
    return text + "\n" if text else ""


def matching_start(events: list[Event], end: Event) -> Event:
    """The start of the container that `end` closes."""
    depth = 0
    at = next(i for i, e in enumerate(events) if e is end)
    for i in range(at, -1, -1):
        if events[i].op == "end":
            depth += 1
        elif events[i].op == "start":
            depth -= 1
            if not depth:
                return events[i]
    return end
