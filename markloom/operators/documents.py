"""Operators over a DataFrame of documents: string in, string or rows out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from operator import attrgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import chunks, collect, filters, handlers
from ..kernel.events import Event
from ..kernel.html import to_html as html_of
from ..kernel.markdown import to_markdown as markdown_of
from ..kernel.options import Options, Truncate, Windows, resolve
from ..kernel.parse import parse
from ..kernel.plain import to_plain_text as plain_of
from ..plans.kernels import kernel, struct

Given = Options | dict | str | None

EVENTS = "seq int, op string, kind string, depth int, node_id int, parent_id int, block_id int, text string, level int, id string, classes array<string>, dest string, title string, link_type string, ref_id string, lang string, fenced boolean, list_start long, align array<string>, alert string, checked boolean, label string, byte_start int, byte_end int"
EXTRACTS = {
    "images": "src string, alt string, title string, byte_start int, byte_end int",
    "links": "href string, text string, title string, byte_start int, byte_end int",
    "code_blocks": "lang string, source string, byte_start int, byte_end int",
    "headings": "level int, text string, id string, byte_start int, byte_end int",
    "footnote_definitions": "label string, text string, byte_start int, byte_end int",
}
STATISTICS = "heading_count int, likely_language string, language_confidence double, character_count int, word_count int, code_block_count int, image_count int, link_count int, footnote_definition_count int"
SECTIONS = "pos int, heading string, level int, id string, breadcrumb array<string>, character_count int, word_count int, content string"
WINDOWS = "index int, content string, character_count int, word_count int"


def one(df: DataFrame, name: str, make: Callable[[str], str | None], on_error: str = "raise") -> DataFrame:
    return kernel(df, lambda s: [{name: make(s)}], struct(f"{name} string"), on_error=on_error)


def to_html(df: DataFrame, options: Given = None, on_error: str = "raise") -> DataFrame:
    """df (source and any other columns) with source replaced by its HTML."""
    o = resolve(options)
    syntax = o.syntax()
    return one(df, "html", lambda s: html_of(filters.apply(parse(s, syntax, False), o)) if s else "", on_error)


def to_markdown(df: DataFrame, options: Given = None, on_error: str = "raise") -> DataFrame:
    """Normalised, filtered Markdown; frontmatter is no content."""
    o = resolve(options)
    return one(df, "markdown", lambda s: markdown_of(chunks.filtered(s, o)) if s else "", on_error)


def to_plain_text(df: DataFrame, options: Given = None, on_error: str = "raise") -> DataFrame:
    o = resolve(options)
    return one(df, "plain_text", lambda s: plain_of(chunks.filtered(s, o)) if s else "", on_error)


def truncate_markdown(df: DataFrame, options: Given = None, on_error: str = "raise", **budget: object) -> DataFrame:
    """Markdown cut to a budget of chars and words, at blocks or words; see Truncate."""
    o, t = resolve(options), Truncate(**budget)
    return one(df, "markdown", lambda s: chunks.truncate_markdown(s, t, o), on_error)


#: Columns that follow from an event's place among the others; the rest are its fields.
PLACES = ("seq", "depth", "node_id", "parent_id", "block_id")


def event_rows(columns: Sequence[str]) -> Callable[[list[Event]], list[tuple]]:
    """From events to tuples of these columns."""
    fields = {c: attrgetter(c.removeprefix("byte_")) for c in columns if c not in PLACES}

    def rows(events: list[Event]) -> list[tuple]:
        found: dict[str, list[int | None]] = {c: [] for c in PLACES}
        depths, nodes, parents, blocks = (found[c].append for c in PLACES[1:])
        open_: list[int] = []
        node, block = -1, -1
        for e in events:
            if e.op == "end":
                nodes(open_.pop())
            else:
                node += 1
                nodes(node)
                block += not open_
            depths(len(open_))
            parents(open_[-1] if open_ else None)
            blocks(block)
            if e.op == "start":
                open_.append(node)
        found["seq"] = range(len(events))
        return list(zip(*(map(fields[c], events) if c in fields else found[c] for c in columns)))

    return rows


def parse_events(df: DataFrame, options: Given = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The event table: one row for each event, before any filter. `columns` of it, else all."""
    syntax, schema = resolve(options).syntax(), struct(EVENTS)
    if unknown := set(columns or ()) - set(schema.names):
        raise ValueError(f"no columns of events: {sorted(unknown)}")
    schema = T.StructType([f for f in schema if columns is None or f.name in columns])
    rows, offsets = event_rows(schema.names), bool({"byte_start", "byte_end"} & set(schema.names))
    return kernel(df, lambda s: rows(parse(s, syntax, offsets)), schema)


def filtered_events(df: DataFrame, options: Given = None) -> DataFrame:
    """The event table after the filters, without frontmatter."""
    o, schema = resolve(options), struct(EVENTS)
    rows = event_rows(schema.names)
    return kernel(df, lambda s: rows(chunks.filtered(s, o, True)), schema)


def extract(df: DataFrame, kind: str, options: Given = None) -> DataFrame:
    """One row for each image, link, code block, heading or footnote definition, before filters."""
    o = resolve(options).merge(extract={kind: True})
    return kernel(df, lambda s: [{"pos": i} | r for i, r in enumerate(collect.extracts(parse(s, o.syntax()))[kind])], struct(f"pos int, {EXTRACTS[kind]}"))


def statistics(df: DataFrame, options: Given = None) -> DataFrame:
    syntax = resolve(options).syntax()
    return kernel(df, lambda s: [collect.statistics(parse(s, syntax))], struct(STATISTICS))


def toc(df: DataFrame, depth: int | None = None, options: Given = None) -> DataFrame:
    """toc_markdown and toc_html, up to a heading level."""
    o = resolve(options).merge(toc={"depth": depth})

    def make(s: str) -> list[dict]:
        markdown, html = collect.toc(collect.heading_rows(parse(s, o.syntax())), o.toc_depth)
        return [{"toc_markdown": markdown, "toc_html": html}]

    return kernel(df, make, struct("toc_markdown string, toc_html string"))


def frontmatter(df: DataFrame, options: Given = None) -> DataFrame:
    """frontmatter_raw, and frontmatter as a variant; null where a document has none."""
    syntax = resolve(options).merge(frontmatter=True).syntax()

    def make(s: str) -> list[dict]:
        raw = collect.frontmatter(parse(s, syntax))
        return [{"frontmatter_raw": raw, "frontmatter_json": collect.frontmatter_json(raw)}]

    out = kernel(df, make, struct("frontmatter_raw string, frontmatter_json string"))
    return out.withColumn("frontmatter", F.parse_json("frontmatter_json")).drop("frontmatter_json")


def render_full(df: DataFrame, options: Given = None) -> DataFrame:
    """HTML with all that options ask to collect, from one parse: html, toc, statistics, extracts,
    frontmatter. What is not asked for is null."""
    o = resolve(options).collecting()
    kinds = collect.wanted(o)
    fields = ", ".join(f"{k}: array<struct<{EXTRACTS[k].replace(' ', ':').replace(',:', ', ')}>>" for k in kinds)
    schema = f"html string, toc_markdown string, toc_html string, heading_count int, statistics struct<{', '.join(x.replace(' ', ': ') for x in STATISTICS.split(', '))}>, frontmatter_raw string" + (f", extracts struct<{fields}>" if kinds else "")

    def make(s: str) -> list[dict]:
        events = parse(s, o.syntax())
        found = collect.extracts(events)
        markdown, toc_html = collect.toc(found["headings"], o.toc_depth) if o.toc else (None, None)
        row = {"html": html_of(filters.apply(events, o)), "toc_markdown": markdown, "toc_html": toc_html, "heading_count": len(found["headings"]) if o.toc else None, "statistics": collect.statistics(events) if o["statistics"] else None, "frontmatter_raw": collect.frontmatter(events)}
        return [row | ({"extracts": {k: found[k] for k in kinds}} if kinds else {})]

    return kernel(df, make, struct(schema))


def chunks_by_heading(df: DataFrame, options: Given = None, truncate: Truncate | dict | None = None) -> DataFrame:
    """Sections by top-level headings, nested ones repeated in theirs; see Truncate for the budget."""
    o, t = resolve(options), Truncate.of(truncate)
    return kernel(df, lambda s: [{"pos": i} | r for i, r in enumerate(chunks.chunks_by_heading(s, o, t))], struct(SECTIONS))


def chunks_by_size(df: DataFrame, options: Given = None, **window: object) -> DataFrame:
    """Windows of bounded size; see Windows."""
    o, w = resolve(options), Windows(**window)
    return kernel(df, lambda s: chunks.chunks_by_size(s, w, o), struct(WINDOWS))


def hybrid_chunks(df: DataFrame, options: Given = None, **window: object) -> DataFrame:
    """Sections by top-level headings, each longer than the window's chars cut into windows; one crossing
    for both."""
    o, w = resolve(options), Windows(**window)
    if w.chars is None:
        raise ValueError("hybrid chunks need a budget of chars")

    def make(s: str) -> list[dict]:
        out = []
        for pos, part in enumerate(chunks.chunks_by_heading(s, o)):
            text = part["content"]
            pieces = [{"index": 0, "content": text}] if len(text) <= w.chars else chunks.chunks_by_size(text, w, o)
            out += [{"pos": pos, "heading": part["heading"], "index": x["index"], "content": x["content"]} for x in pieces]
        return out

    return kernel(df, make, struct("pos int, heading string, index int, content string"))


def to_html_with(df: DataFrame, on: handlers.Handlers, options: Given = None) -> DataFrame:
    """HTML after handlers have changed, replaced or deleted elements."""
    o = resolve(options)
    return one(df, "html", lambda s: handlers.to_html_with(s, on, o) if s else "")


def walk(df: DataFrame, on: handlers.Handlers, options: Given = None) -> DataFrame:
    """One row for each handler call, children before parents: kind, depth, ancestors, and what the
    handler returned as text. Handlers run on executors: what they do elsewhere is lost."""
    o = resolve(options)

    def make(s: str) -> list[dict]:
        return [{"seq": i, "kind": e.kind, "depth": e.depth, "parent_kind": e.parent_kind, "ancestor_kinds": e.ancestor_kinds, "value": None if v is None else str(v)} for i, (e, v) in enumerate(handlers.walk(s, on, o))]

    return kernel(df, make, struct("seq int, kind string, depth int, parent_kind string, ancestor_kinds array<string>, value string"))
