"""The same operators as relations over the event table: DataFrame functions only.

They agree with the kernels, and serve where events are already at hand or columns of other tables
join in. Joins of events with themselves read them twice: store the event table first; neither side is
ever broadcast, as both grow with the documents. `key` names the columns that tell documents apart;
windows run within a document.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

KEY = ("doc_id",)
#: Columns of events that headings() and all after it read; that text and counts are made of.
HEADINGS = ("seq", "op", "kind", "depth", "text", "level")
TEXTS = ("seq", "op", "kind", "text")


def within(key: tuple[str, ...]) -> Window:
    return Window.partitionBy(*key)


def content_events(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Events without metadata blocks: a running sum of what is open tells what is inside."""
    mark = F.when(F.col("kind") == "metadata_block", F.when(F.col("op") == "start", 1).otherwise(-1)).otherwise(0)
    inside = F.sum(mark).over(within(key).orderBy("seq"))
    return events.withColumn("__in", inside).where("__in = 0 AND kind <> 'metadata_block'").drop("__in")


def with_depth(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """events with running_depth (containers open around the event) and block_ordinal (which
    top-level block it belongs to)."""
    delta = F.when(F.col("op") == "start", 1).when(F.col("op") == "end", -1).otherwise(0)
    upto = F.sum(delta).over(within(key).orderBy("seq"))
    depth = F.when(F.col("op") == "start", upto - 1).otherwise(upto)
    events = events.withColumn("running_depth", depth)
    opens = ((F.col("running_depth") == 0) & (F.col("op") != "end")).cast("int")
    return events.withColumn("block_ordinal", F.sum(opens).over(within(key).orderBy("seq")) - 1)


def marked(rows: DataFrame, kind: str, key: tuple[str, ...]) -> DataFrame:
    """rows with __first (starts an outermost element of a kind), __element (its number within the
    document) and __inside, by running sums over starts and ends."""
    own = F.col("kind") == kind
    delta = F.when(own & (F.col("op") == "start"), 1).when(own & (F.col("op") == "end"), -1).otherwise(0)
    order = within(key).orderBy("seq")
    rows = rows.withColumn("__open", F.sum(delta).over(order))
    first = own & (F.col("op") == "start") & (F.col("__open") == 1)
    rows = rows.withColumn("__first", first).withColumn("__element", F.sum(F.col("__first").cast("int")).over(order))
    return rows.withColumn("__inside", (F.col("__open") > 0) | own)


def spoken(inside: Column) -> Column:
    """The text and code inside, joined in order: an aggregate."""
    leaf = inside & (F.col("op") == "leaf") & F.col("kind").isin("text", "code")
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(leaf, F.struct("seq", "text")))), lambda x: x["text"]), "")


def elements(events: DataFrame, kind: str, fields: tuple[str, ...], key: tuple[str, ...] = KEY) -> DataFrame:
    """The outermost elements of a kind: key, seq, end_seq, depth, the fields of their start, and text
    (the text and code inside, joined). Running sums tell which element an event is in, so the events
    are read once and sorted once within their document."""
    rows = events.where((F.col("kind") == kind) | ((F.col("op") == "leaf") & F.col("kind").isin("text", "code")))
    at_start = lambda c: F.max(F.when(F.col("__first"), F.col(c)))
    return marked(rows, kind, key).where("__inside").groupBy(*key, "__element").agg(
        F.min("seq").alias("seq"), F.max("seq").alias("end_seq"), at_start("depth").alias("depth"), *(at_start(c).alias(c) for c in fields),
        spoken(F.col("__inside")).alias("text"),
    ).drop("__element")


def headings(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Every heading: key, seq, end_seq, depth, level, heading (its text and code, joined), slug, id
    (the slug, numbered from the second of its kind on; null for an empty one)."""
    found = elements(events, "heading", ("level",), key).withColumnRenamed("text", "heading")
    return numbered_slugs(found.withColumn("slug", S.slugify_ascii(F.col("heading"))), key)


def numbered_slugs(headings: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """headings (key, seq, slug) with id: the base, then base-1, base-2; null for an empty slug. A
    generated id may equal another heading's slug."""
    n = F.row_number().over(Window.partitionBy(*key, "slug").orderBy("seq"))
    return headings.withColumn("id", F.when(F.col("slug") != "", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (n - 1).cast("string")))))


def statistics(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The element counts of each document, of headings those whose slug is not empty. The events are
    read once: each heading is a group of its own first, all that is in none is another."""
    kinds = ("code_block", "image", "link", "footnote_definition")
    starts = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("op") == "start")).alias(f"{kind}_count")
    rows = marked(events.where("op <> 'end' OR kind = 'heading'"), "heading", key)
    groups = rows.groupBy(*key, F.when(F.col("__inside"), F.col("__element")).alias("__heading")).agg(spoken(F.col("__inside")).alias("__text"), *map(starts, kinds))
    named = F.col("__heading").isNotNull() & (S.slugify_ascii(F.col("__text")) != "")
    return groups.groupBy(*key).agg(*(F.sum(f"{k}_count").cast("int").alias(f"{k}_count") for k in kinds), F.count_if(named).cast("int").alias("heading_count"))


def counted_text(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """key, text, character_count: text and code payloads with a space each, breaks as one more
    space outside code, trimmed of all white space for the count."""
    code = F.sum(F.when(F.col("kind") == "code_block", F.when(F.col("op") == "start", 1).otherwise(-1)).otherwise(0)).over(within(key).orderBy("seq"))
    rows = content_events(events, key).withColumn("__code", code).where("op = 'leaf'")
    piece = F.when(F.col("kind").isin("text", "code"), F.concat("text", F.lit(" "))).when(F.col("kind").isin("soft_break", "hard_break") & (F.col("__code") == 0), F.lit(" "))
    rows = rows.withColumn("__piece", piece).where("__piece IS NOT NULL")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "__piece"))), lambda x: x["__piece"]), "")
    return rows.groupBy(*key).agg(text.alias("text")).withColumn("character_count", F.length(S.trim_all(F.col("text"))))


def element_text(events: DataFrame, kind: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """Each outermost element of a kind with the text inside it and where it stands in the source."""
    return elements(events, kind, ("dest", "title", "lang", "label", "byte_start", "byte_end"), key)


def toc(heads: DataFrame, depth: int = 6, key: tuple[str, ...] = KEY) -> DataFrame:
    """key, toc_markdown: the headings with ids up to a level, indented from the least level left."""
    rows = heads.where((F.col("level") <= depth) & F.col("id").isNotNull())
    rows = rows.withColumn("__least", F.min("level").over(within(key)))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - F.col("__least")), F.lit("- ["), S.toc_escape(F.col("heading")), F.lit("](#"), F.col("id"), F.lit(")\n"))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("seq"), line.alias("line")))), lambda x: x["line"]), "").alias("toc_markdown"))


def sections(heads: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The sections of top-level headings: heading rows with section_end (seq of the next top-level
    heading of their level or higher, null at the document's end) and breadcrumb. Frames only grow by a
    row at a time, so the work is linear in the headings of a document."""
    level = F.col("level")
    upto = lambda order: within(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.min(F.when(level <= n, F.col("seq"))).over(upto(F.desc("seq"))) for n in range(1, 7)]
    end = F.coalesce(*(F.when(level == n, ends[n - 1]) for n in range(1, 7)))
    # the latest heading of a level stands above this one unless a higher one came after it
    latest = [F.last(F.when(level == n, F.struct("seq", "heading")), ignorenulls=True).over(upto(F.col("seq"))) for n in range(1, 6)]
    top = heads.where("depth = 0").withColumn("section_end", end).withColumn("__latest", F.array(*latest))
    at = [F.col("__latest")[n]["seq"] for n in range(5)]
    above = [F.when((level > n + 1) & (at[n] > F.greatest(F.lit(-1), F.lit(-1), *at[:n])), F.col("__latest")[n]["heading"]) for n in range(5)]
    return top.withColumn("breadcrumb", F.array_compact(F.array(*above))).drop("__latest")


def section_members(events: DataFrame, parts: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Events with the sections that hold them (parts as sections() gives them). At most one section of
    each level is open at an event, so the sections run along with the events in one sorted pass:
    nothing is joined, broadcast or multiplied."""
    known = [F.col(k).isNotNull() for k in key]
    section = F.struct("level", F.col("end_seq").alias("from_seq"), "section_end", F.col("id").alias("section_id"))
    marks = parts.where(F.col("level").isNotNull()).select(*key, F.col("end_seq").alias("seq"), section.alias("__section"))
    rows = events.unionByName(marks, allowMissingColumns=True).where(reduce(and_, known))
    upto = within(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.last(F.when(F.col("__section.level") == n, F.col("__section")), ignorenulls=True).over(upto) for n in range(1, 7)]
    holds = lambda s: s.isNotNull() & (F.col("seq") > s["from_seq"]) & (s["section_end"].isNull() | (F.col("seq") < s["section_end"]))
    rows = rows.withColumn("__latest", F.array(*latest)).where("__section IS NULL")
    return rows.withColumn("__held", F.explode(F.filter("__latest", holds))).select(*events.columns, F.col("__held.section_id").alias("section_id"))


def ancestors(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Pairs of an event and a container around it: key, seq, kind, ancestor_kind, ancestor_depth."""
    start = events.where("op = 'start'").select(*(F.col(k).alias(f"__{k}") for k in key), F.col("node_id").alias("__node"), F.col("seq").alias("from_seq"), F.col("kind").alias("ancestor_kind"), F.col("depth").alias("ancestor_depth"))
    end = events.where("op = 'end'").select(*(F.col(k).alias(f"__{k}") for k in key), F.col("node_id").alias("__node"), F.col("seq").alias("to_seq"))
    spans = start.join(end.hint("merge"), [*(f"__{k}" for k in key), "__node"])
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [F.col("seq") > F.col("from_seq"), F.col("seq") < F.col("to_seq")]
    return events.where("op <> 'end'").join(spans.hint("merge"), on).select(*key, "seq", "kind", "ancestor_kind", "ancestor_depth")


def unwrap(events: DataFrame, kind: str, blocked: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """events without the starts and ends of blocked elements of a kind; what is inside stays."""
    out = events.where((F.col("kind") == kind) & (F.col("op") == "start") & blocked).select(*key, F.col("node_id"))
    return events.join(out.withColumn("kind", F.lit(kind)).hint("merge"), [*key, "node_id", "kind"], "left_anti")


def suppress_raw_html(events: DataFrame) -> DataFrame:
    return events.withColumn("kind", F.when(F.col("kind").isin("html", "inline_html"), "text").otherwise(F.col("kind")))


def hard_wrap(events: DataFrame) -> DataFrame:
    return events.withColumn("kind", F.when(F.col("kind") == "soft_break", "hard_break").otherwise(F.col("kind")))


def truncate_blocks(blocks: DataFrame, chars: int, marker: str | None = "…", key: tuple[str, ...] = KEY) -> DataFrame:
    """key, markdown: blocks (key, block_id, markdown) kept while they fit the budget; a running sum
    of lengths, separators included, finds the first that does not."""
    budget = chars - len(marker or "")
    order = within(key).orderBy("block_id")
    size = F.length(F.rtrim("markdown")) + F.when(F.row_number().over(order) > 1, 2).otherwise(0)
    over = F.sum(size).over(order) > budget
    rows = blocks.withColumn("__over", over)
    rows = rows.withColumn("__keep", F.max(F.col("__over").cast("int")).over(order) == 0)
    kept = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__keep"), F.struct("block_id", "markdown")))), lambda x: x["markdown"]), "\n\n")
    out = rows.groupBy(*key).agg(kept.alias("kept"), F.min(F.col("__keep").cast("int")).alias("all"))
    tail = F.lit("" if marker is None else f"\n\n{marker}")
    whole = F.when((F.col("all") == 1) | (F.col("kept") == ""), F.col("kept")).otherwise(F.concat(F.rtrim("kept"), tail, F.lit("\n")))
    return out.select(*key, whole.alias("markdown"))


def html_fragments(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """key, html of documents of paragraphs, headings and simple inlines: a fragment for each event,
    joined in order."""
    tags = {"paragraph": "p", "emphasis": "em", "strong": "strong", "strikethrough": "del"}
    piece = F.lit("")
    for kind, tag in tags.items():
        end = f"</{tag}>" + ("\n" if kind == "paragraph" else "")
        piece = F.when(F.col("kind") == kind, F.when(F.col("op") == "start", f"<{tag}>").otherwise(end)).otherwise(piece)
    piece = F.when(F.col("kind") == "heading", F.when(F.col("op") == "start", F.concat(F.lit("<h"), F.col("level"), F.lit(">"))).otherwise(F.concat(F.lit("</h"), F.col("level"), F.lit(">\n")))).otherwise(piece)
    piece = F.when(F.col("kind") == "text", S.escape_text(F.col("text"))).when(F.col("kind") == "code", F.concat(F.lit("<code>"), S.escape_text(F.col("text")), F.lit("</code>"))).when(F.col("kind") == "soft_break", "\n").when(F.col("kind") == "hard_break", "<br />\n").when(F.col("kind") == "rule", "<hr />\n").otherwise(piece)
    rows = events.select(*key, "seq", piece.alias("piece"))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("html"))
