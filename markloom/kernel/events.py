"""The event stream: what a parsed document is made of.

A document is a flat list of events in source order: `start` and `end` of containers, and leaves.
Byte ranges are exclusive and refer to the UTF-8 source; a start's range spans its element.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

CONTAINERS = (
    "paragraph", "heading", "blockquote", "code_block", "html_block", "list", "ordered_list", "list_item",
    "footnote_definition", "table", "table_head", "table_row", "table_cell", "emphasis", "strong",
    "strikethrough", "link", "image", "definition_list", "definition_list_title",
    "definition_list_definition", "superscript", "subscript", "metadata_block",
)
LEAVES = ("text", "code", "html", "inline_html", "soft_break", "hard_break", "rule", "footnote_reference", "inline_math", "display_math", "task_list_marker")


@dataclass(slots=True)
class Event:
    op: str  # start, end, leaf
    kind: str
    text: str = ""
    level: int | None = None
    id: str | None = None
    classes: Sequence[str] = ()
    attrs: Sequence[tuple[str, str | None]] = ()
    dest: str | None = None
    title: str | None = None
    link_type: str | None = None
    ref_id: str | None = None
    lang: str | None = None
    fenced: bool | None = None
    list_start: int | None = None
    align: list[str] | None = None
    alert: str | None = None
    checked: bool | None = None
    label: str | None = None
    start: int = 0
    end: int = 0

    def but(self, **changes: object) -> Event:
        return replace(self, **changes)


def text_event(text: str, like: Event | None = None) -> Event:
    return Event("leaf", "text", text, start=like.start if like else 0, end=like.end if like else 0)


def matching_end(events: list[Event], i: int) -> int:
    """The place of the end that belongs to the start at i."""
    depth = 0
    for j in range(i, len(events)):
        if events[j].op == "start":
            depth += 1
        elif events[j].op == "end":
            depth -= 1
            if not depth:
                return j
    return len(events) - 1


def inner_text(events: list[Event]) -> str:
    """Text and code payloads, joined."""
    return "".join(e.text for e in events if e.op == "leaf" and e.kind in ("text", "code"))
