"""Statistics, extracts, tables of contents and frontmatter of one document."""

from __future__ import annotations

import json

from .events import Event, inner_text, matching_end
from .html import escape, escape_text
from .options import Options
from .words import Slugs, count_words, detect_language


def counted_text(events: list[Event]) -> str:
    """Text and code payloads, each with a space; a break is one more. Metadata does not count."""
    out, code, metadata = [], False, False
    for e in events:
        if e.kind == "metadata_block":
            metadata = e.op == "start"
        elif e.kind == "code_block":
            code = e.op == "start"
        elif metadata or e.op != "leaf":
            continue
        elif e.kind in ("text", "code"):
            out += [e.text, " "]
        elif e.kind in ("soft_break", "hard_break") and not code:
            out.append(" ")
    return "".join(out)


def counts(text: str) -> tuple[int, int]:
    text = text.strip()
    return len(text), count_words(text)


def heading_rows(events: list[Event]) -> list[dict]:
    """Headings whose slug is not empty, with slugs that do not heed explicit ids."""
    slugs, out = Slugs(), []
    for i, e in enumerate(events):
        if e.kind == "heading" and e.op == "start":
            text = inner_text(events[i : matching_end(events, i)])
            if slug := slugs.take(text):
                out.append({"level": e.level, "text": text, "id": slug, "byte_start": e.start, "byte_end": e.end})
    return out


def extracts(events: list[Event]) -> dict[str, list[dict]]:
    """Records by kind, in the order in which their elements end."""
    out: dict[str, list[dict]] = {"images": [], "links": [], "code_blocks": [], "headings": heading_rows(events), "footnote_definitions": []}
    open_: list[tuple[Event, int]] = []
    image: tuple[Event, list[str]] | None = None
    for i, e in enumerate(events):
        if e.op == "start":
            open_.append((e, i))
            if e.kind == "image":
                image = (e, [])
        elif e.op == "leaf":
            if image and e.kind in ("text", "code"):
                image[1].append(e.text)
        else:
            start, at = open_.pop()
            span = {"byte_start": start.start, "byte_end": start.end}
            inner = events[at + 1 : i]
            if e.kind == "image" and image:
                out["images"].append({"src": image[0].dest, "alt": "".join(image[1]), "title": image[0].title or "", "byte_start": image[0].start, "byte_end": image[0].end})
                image = None
            elif e.kind == "link":
                out["links"].append({"href": start.dest, "text": inner_text(inner), "title": start.title or "", **span})
            elif e.kind == "code_block":
                out["code_blocks"].append({"lang": start.lang or "", "source": inner_text(inner), **span})
            elif e.kind == "footnote_definition":
                text = "".join(f"{x.text} " for x in inner if x.op == "leaf" and x.kind in ("text", "code"))
                out["footnote_definitions"].append({"label": start.label, "text": text.removesuffix(" "), **span})
    return out


def statistics(events: list[Event]) -> dict:
    """The scalar statistics, from events before any filter."""
    text = counted_text(events)
    found = extracts(events)
    language, confidence = detect_language(text)
    chars, words = counts(text)
    return {
        "heading_count": len(found["headings"]), "likely_language": language, "language_confidence": confidence, "character_count": chars, "word_count": words,
        "code_block_count": len(found["code_blocks"]), "image_count": len(found["images"]), "link_count": len(found["links"]),
        "footnote_definition_count": len(found["footnote_definitions"]),
    }


def toc(headings: list[dict], depth: int | None = None) -> tuple[str, str]:
    """The table of contents as a Markdown list and as nested HTML lists."""
    rows = [h for h in headings if depth is None or h["level"] <= depth]
    if not rows:
        return "", ""
    least = min(h["level"] for h in rows)
    marked = lambda t: t.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
    markdown = "".join(f"{'  ' * (h['level'] - least)}- [{marked(h['text'])}](#{h['id']})\n" for h in rows)
    out, levels = [], []
    for h in rows:
        while levels and levels[-1] >= h["level"]:
            levels.pop()
            out.append("</li>\n</ul>\n")
        out.append(f'<ul>\n<li><a href="#{escape(h["id"])}">{escape_text(h["text"])}</a>\n')
        levels.append(h["level"])
    return markdown, "".join(out) + "</li>\n</ul>\n" * len(levels)


def frontmatter(events: list[Event]) -> str | None:
    """The raw YAML, if there is a metadata block."""
    for i, e in enumerate(events):
        if e.kind == "metadata_block" and e.op == "start":
            return "".join(x.text for x in events[i + 1 : matching_end(events, i)])
    return None


def frontmatter_json(raw: str | None) -> str | None:
    """The YAML, safely loaded, as JSON. Errors in it surface."""
    if raw is None:
        return None
    import yaml

    return json.dumps(yaml.safe_load(raw), default=str, ensure_ascii=False)


def wanted(o: Options) -> tuple[str, ...]:
    """The extract kinds that options ask for; a table of contents asks for headings."""
    kinds = [k for k, on in (o.extract or ()) if on]
    return tuple(kinds) + (("headings",) if o.toc and "headings" not in kinds else ())
