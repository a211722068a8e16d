"""The queries of the Markdown operators and their SQL twins.

Most make Markdown out of table columns with an expression that Spark and DuckDB both know, so
that the expected output is plain SQL over the same columns. Every query takes its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .kernel.handlers import Handlers
from .kernel.highlight import highlight_css, highlight_themes
from .kernel.options import Options, Truncate, Windows
from .operators import documents as D
from .operators import relational as R
from .plans.kernels import spread
from .streaming import batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = {"nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "pages": "page_id", "documents": "doc_id"}
NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def made(spark: SparkSession, sf_dir: str, name: str, source: str) -> DataFrame:
    """doc_id, source: Markdown made from each row of a table."""
    return spread(table(spark, sf_dir, name)).selectExpr(f"cast({KEYS[name]} AS long) AS doc_id", f"{source} AS source")


def case(name: str, of: str, source: str, op: Callable[[DataFrame], DataFrame], expected: dict[str, str], where: str = "") -> None:
    """A query of `op` over Markdown made from table `of`; `expected` are its columns in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(made(spark, sf_dir, of, source)).select("doc_id", *expected)

    QUERIES[name] = run
    SQL[name] = f"SELECT {KEYS[of]}::BIGINT AS doc_id, {', '.join(f'{v} AS {k}' for k, v in expected.items())} FROM {of} {where}"


def html(**options: object) -> Callable[[DataFrame], DataFrame]:
    return lambda df: D.to_html(df, dict(options) or "gfm")


def markdown(**options: object) -> Callable[[DataFrame], DataFrame]:
    return lambda df: D.to_markdown(df, dict(options) or "gfm")


def p(inner: str) -> str:
    return f"'<p>' || {inner} || '</p>' || {NL}"


SLUG = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g')"
NATION = f"'# ' || n_name || {NL} || {NL} || '**nation** of *the* `world`' || {NL}"

# -- sources and sinks


@query("src1_scan", "SELECT doc_id, coalesce(text, '') AS source FROM documents")
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.documents import from_column

    return from_column(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    "src2_parse_events",
    """SELECT n_nationkey::BIGINT AS doc_id, seq, op, kind, CASE WHEN text = '@' THEN n_name ELSE text END AS text FROM nation, (VALUES
    (0, 'start', 'heading', ''), (1, 'leaf', 'text', '@'), (2, 'end', 'heading', ''), (3, 'start', 'paragraph', ''), (4, 'start', 'strong', ''),
    (5, 'leaf', 'text', 'nation'), (6, 'end', 'strong', ''), (7, 'leaf', 'text', ' of '), (8, 'start', 'emphasis', ''), (9, 'leaf', 'text', 'the'),
    (10, 'end', 'emphasis', ''), (11, 'leaf', 'text', ' '), (12, 'leaf', 'code', 'world'), (13, 'end', 'paragraph', '')) e(seq, op, kind, text)""",
)
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_events(made(spark, sf_dir, "nation", NATION)).select("doc_id", "seq", "op", "kind", "text")


@query("src2_documents_events")
def src2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")))
    return D.parse_events(docs).groupBy("kind", "op").agg(F.count("*").alias("events"), F.sum(F.length("text")).alias("chars"))


case("src3_byte_ranges", "pages", "'see [p' || page_id || '](' || url || ')'", lambda df: D.extract(df, "links"), {"href": "url", "byte_start": "4", "byte_end": "strlen('see [p' || page_id || '](' || url || ')')"})


@query("src4_content_scan", "SELECT n_nationkey::BIGINT AS doc_id, 3::BIGINT AS events, n_name AS text FROM nation")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "nation", f"'---' || {NL} || 'title: x' || {NL} || '---' || {NL} || '# ' || n_name || {NL}")
    events = R.content_events(D.parse_events(docs, {"frontmatter": True}))
    return events.groupBy("doc_id").agg(F.count("*").alias("events"), F.max("text").alias("text"))


def frontmatter_of(df: DataFrame) -> DataFrame:
    out = D.frontmatter(df)
    return out.select("doc_id", "frontmatter_raw", F.variant_get("frontmatter", "$.title", "string").alias("title"), F.variant_get("frontmatter", "$.size", "int").alias("size"))


case("src5_frontmatter", "part", f"'---' || {NL} || 'title: ' || p_name || {NL} || 'size: ' || p_size || {NL} || '---' || {NL} || '# x'", frontmatter_of, {"frontmatter_raw": f"'title: ' || p_name || {NL} || 'size: ' || p_size || {NL}", "title": "p_name", "size": "p_size"})
case("snk1_to_html", "nation", NATION, html(), {"html": f"'<h1>' || n_name || '</h1>' || {NL} || '<p><strong>nation</strong> of <em>the</em> <code>world</code></p>' || {NL}"})


@query("snk1_documents_html")
def snk1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.to_html(spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))), "recommended")


case("snk2_to_markdown", "part", f"p_name || {NL} || '=====' || {NL} || '__bold__ _em_'", markdown(), {"markdown": f"'# ' || p_name || {NL} || {NL} || '**bold** *em*'"})
case("snk3_plain_text", "part", f"'# ' || p_name || {NL} || {NL} || '- one' || {NL} || '- **two**' || {NL} || {NL} || '> quote' || {NL} || '> on'", D.to_plain_text, {"plain_text": f"p_name || {NL} || {NL} || '- one' || {NL} || '- two' || {NL} || {NL} || '> quote on' || {NL}"})


@query("snk3_documents_plain_text")
def snk3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.to_plain_text(spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))))


OUTLINE = f"'# ' || p_name || {NL} || {NL} || 'a' || {NL} || {NL} || '## Size ' || p_size || {NL} || {NL} || 'b' || {NL} || {NL} || '## Size ' || p_size || {NL} || {NL} || 'c'"
P, Z = SLUG("p_name"), "'size-' || p_size"
case("snk4_toc", "part", OUTLINE, lambda df: D.toc(df), {
    "toc_markdown": f"'- [' || p_name || '](#' || {P} || ')' || {NL} || '  - [Size ' || p_size || '](#' || {Z} || ')' || {NL} || '  - [Size ' || p_size || '](#' || {Z} || '-1)' || {NL}",
    "toc_html": f"'<ul>' || {NL} || '<li><a href=\"#' || {P} || '\">' || p_name || '</a>' || {NL} || '<ul>' || {NL} || '<li><a href=\"#' || {Z} || '\">Size ' || p_size || '</a>' || {NL} || '</li>' || {NL} || '</ul>' || {NL} || '<ul>' || {NL} || '<li><a href=\"#' || {Z} || '-1\">Size ' || p_size || '</a>' || {NL} || '</li>' || {NL} || '</ul>' || {NL} || '</li>' || {NL} || '</ul>' || {NL}",
})
case("l2_toc_depth", "part", OUTLINE, lambda df: D.toc(df, 1), {"toc_markdown": f"'- [' || p_name || '](#' || {P} || ')' || {NL}"})


@query("snk5_highlight_css")
def snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, highlight_css(t)) for t in highlight_themes()], "theme string, css string")


case("snk6_inert_html", "part", f"'<div>' || {NL} || '  ' || p_name || '  ' || {NL} || '</div>'", markdown(), {"markdown": f"'\\<div\\>' || {NL} || p_name || {NL} || '\\</div\\>'"})
case("snk7_tidy_edges", "part", f"'**[' || p_name || {NL} || '](https://evil.com)**'", markdown(links={"allowed_hosts": []}), {"markdown": "'**' || p_name || '**'"})
case("snk8_block_sink", "part", f"'para' || {NL} || {NL} || '---' || {NL} || {NL} || '```sql' || {NL} || 'select ' || p_size || {NL} || '```'", markdown(), {"markdown": f"'para' || {NL} || {NL} || '---' || {NL} || {NL} || '```sql' || {NL} || 'select ' || p_size || {NL} || '```'"})
case("snk9_markdown_heading_ids", "part", "'## ' || p_name || ' *x*'", markdown(headings={"ids": True}), {"markdown": f"'## ' || p_name || ' *x* {{ #' || {SLUG('p_name')} || '-x }}'"})

# -- syntax

case("px1_alerts", "part", f"'> [!NOTE]' || {NL} || '> ' || p_name", html(), {"html": f"'<blockquote class=\"markdown-alert-note\">' || {NL} || '<p>' || p_name || '</p>' || {NL} || '</blockquote>' || {NL}"})
case("px2_tables", "part", f"'| name | size |' || {NL} || '|:--|--:|' || {NL} || '| ' || p_name || ' | ' || p_size || ' |'", html(), {"html": f"'<table><thead><tr><th style=\"text-align: left\">name</th><th style=\"text-align: right\">size</th></tr></thead><tbody>' || {NL} || '<tr><td style=\"text-align: left\">' || p_name || '</td><td style=\"text-align: right\">' || p_size || '</td></tr>' || {NL} || '</tbody></table>' || {NL}"})
case("px3_strikethrough", "part", "'~~' || p_name || '~~'", html(), {"html": p("'<del>' || p_name || '</del>'")})
case("px4_tasklists", "part", f"'- [x] ' || p_name || {NL} || '- [ ] todo'", html(), {"html": f"'<ul>' || {NL} || '<li><input disabled=\"\" type=\"checkbox\" checked=\"\"/>' || {NL} || p_name || '</li>' || {NL} || '<li><input disabled=\"\" type=\"checkbox\"/>' || {NL} || 'todo</li>' || {NL} || '</ul>' || {NL}"})
case("px5_footnotes", "part", f"'See[^n].' || {NL} || {NL} || '[^n]: ' || p_name", html(), {"html": f"'<p>See<sup class=\"footnote-reference\"><a href=\"#n\">1</a></sup>.</p>' || {NL} || '<div class=\"footnote-definition\" id=\"n\"><sup class=\"footnote-definition-label\">1</sup>' || {NL} || '<p>' || p_name || '</p>' || {NL} || '</div>' || {NL}"})
case("px6_smart_punctuation", "part", "chr(34) || p_name || chr(34) || ' -- a...'", html(smart_punctuation=True), {"html": p("'“' || p_name || '” – a…'")})
case("px7_heading_attributes", "part", "'# ' || p_name || ' {#id' || p_size || ' .c}'", html(headings={"attributes": True}), {"html": f"'<h1 id=\"id' || p_size || '\" class=\"c\">' || p_name || '</h1>' || {NL}"})
case("px8_math", "part", "'$a+' || p_size || '$'", html(math=True), {"html": p("'<span class=\"math math-inline\">a+' || p_size || '</span>'")})
case("px9_definition_list", "part", f"p_name || {NL} || ': size ' || p_size", html(definition_list=True), {"html": f"'<dl>' || {NL} || '<dt>' || p_name || '</dt>' || {NL} || '<dd>size ' || p_size || '</dd>' || {NL} || '</dl>' || {NL}"})
case("px10_superscript", "part", "'x^' || p_size || '^'", html(superscript=True), {"html": p("'x<sup>' || p_size || '</sup>'")})
case("px11_subscript", "part", "'x~' || p_size || '~'", html(subscript=True), {"html": p("'x<sub>' || p_size || '</sub>'")})
case("px12_wikilinks", "part", "'[[Page' || p_size || '|' || p_name || ']]'", html(wikilinks=True), {"html": p("'<a href=\"Page' || p_size || '\">' || p_name || '</a>'")})
case("px13_frontmatter", "part", f"'---' || {NL} || 'a: 1' || {NL} || '---' || {NL} || p_name", html(frontmatter=True), {"html": p("p_name")})
case("px14_raw_html", "part", "'a <b>' || p_name || '</b>'", html(raw_html=True), {"html": p("'a <b>' || p_name || '</b>'")})

# -- filters and predicates

case("f1_emoji", "part", "':rocket: ' || p_name || ' :nosuch: 8:00:tada:'", html(emoji_shortcodes=True), {"html": p("'🚀 ' || p_name || ' :nosuch: 8:00🎉'")})
case("f2_autolink", "pages", "'Go to ' || url || '.'", html(links={"autolink": True}), {"html": p("'Go to <a href=\"' || replace(url, '&', '&amp;') || '\">' || replace(url, '&', '&amp;') || '</a>.'")})
case("f3_heading_ids", "part", OUTLINE, html(headings={"ids": True}), {"html": f"'<h1 id=\"' || {P} || '\">' || p_name || '</h1>' || {NL} || '<p>a</p>' || {NL} || '<h2 id=\"' || {Z} || '\">Size ' || p_size || '</h2>' || {NL} || '<p>b</p>' || {NL} || '<h2 id=\"' || {Z} || '-1\">Size ' || p_size || '</h2>' || {NL} || '<p>c</p>' || {NL}"})


@query("f3_heading_ids_relational", f"SELECT p_partkey::BIGINT AS doc_id, seq, CASE seq WHEN 0 THEN {P} WHEN 6 THEN {Z} ELSE {Z} || '-1' END AS id FROM part, (VALUES (0), (6), (12)) s(seq)")
def f3_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.headings(D.parse_events(made(spark, sf_dir, "part", OUTLINE), columns=R.HEADINGS)).select("doc_id", "seq", "id")


case("f4_tag_filter", "part", "'a <script>' || p_name || '</script> <b>x</b>'", html(raw_html=True), {"html": p("'a &lt;script>' || p_name || '&lt;/script> <b>x</b>'")})
case("f5_suppress_html", "part", "'a <b>' || p_name || '</b>'", html(), {"html": p("'a &lt;b&gt;' || p_name || '&lt;/b&gt;'")})
case("f6_hard_wrap", "part", f"'one' || {NL} || p_name", html(hard_wrap=True), {"html": p(f"'one<br />' || {NL} || p_name")})


@query("f7_highlight")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.to_html(made(spark, sf_dir, "part", f"'```python' || {NL} || 'x = ' || p_size || {NL} || '```'"), {"syntax_highlight": True})


HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"
LINK = "'[p' || page_id || '](' || url || ')'"
A_HREF = "'<a href=\"' || replace(url, '&', '&amp;') || '\">p' || page_id || '</a>'"
case("f8_link_hosts", "pages", LINK, html(links={"allowed_hosts": ["*.com"]}), {"html": p(f"CASE WHEN {HOST} LIKE '%.com' THEN {A_HREF} ELSE 'p' || page_id END")})
case("f9_image_hosts", "pages", "'!' || " + LINK, html(images={"allowed_hosts": ["*.com"]}), {"html": p(f"CASE WHEN {HOST} LIKE '%.com' THEN '<img src=\"' || replace(url, '&', '&amp;') || '\" alt=\"p' || page_id || '\" />' ELSE 'p' || page_id END")})
case("f10_schemes", "pages", LINK + " || ' !' || " + LINK, html(links={"allowed_schemes": ["https"]}, images={"allowed_schemes": ["https"]}), {"html": p(f"CASE WHEN url LIKE 'https:%' THEN {A_HREF} || ' <img src=\"' || replace(url, '&', '&amp;') || '\" alt=\"p' || page_id || '\" />' ELSE 'p' || page_id || ' p' || page_id END")})
case("f11_lazy_images", "pages", "'!' || " + LINK, html(images={"lazy": True}), {"html": p("'<img src=\"' || replace(url, '&', '&amp;') || '\" alt=\"p' || page_id || '\" loading=\"lazy\" decoding=\"async\" />'")})
case("f12_nofollow", "pages", LINK, html(links={"nofollow": True}), {"html": p("'<a href=\"' || replace(url, '&', '&amp;') || '\" rel=\"nofollow noopener\">p' || page_id || '</a>'")})


def scalar(name: str, of: str, made_by: Callable[[], dict], expected: dict[str, str]) -> None:
    """A query of scalar functions over the columns of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(table(spark, sf_dir, of)).select(F.col(KEYS[of]).cast("long").alias("doc_id"), *(c.alias(k) for k, c in made_by().items()))

    QUERIES[name] = run
    SQL[name] = f"SELECT {KEYS[of]}::BIGINT AS doc_id, {', '.join(f'{v} AS {k}' for k, v in expected.items())} FROM {of}"


col = F.col
scalar("p1_host_predicate", "pages", lambda: {"allowed": S.is_host_allowed(col("url"), ["*.example.com", "{a,b}.org"])}, {"allowed": f"({HOST} LIKE '%.example.com' OR {HOST} IN ('a.org', 'b.org'))"})
scalar("p2_scheme_predicate", "pages", lambda: {"allowed": S.is_scheme_allowed(col("url"), ["https"]), "relative": S.is_scheme_allowed(F.concat(F.lit("/p/"), col("page_id")), [])}, {"allowed": "url LIKE 'https:%'", "relative": "true"})
scalar("p3_external_predicate", "pages", lambda: {"external": S.is_external(col("url")), "mail": S.is_external(F.concat(F.lit("mailto:"), col("url")))}, {"external": "regexp_matches(url, '^https?://')", "mail": "false"})


@query("p4_record_filter", "SELECT p_partkey::BIGINT AS doc_id, 'Size ' || p_size AS heading FROM part WHERE p_size > 25")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part")).where("p_size > 25").selectExpr("cast(p_partkey AS long) AS doc_id", f"{OUTLINE} AS source")
    return D.chunks_by_heading(parts).where("id LIKE 'size%' AND NOT id LIKE '%-1'").select("doc_id", "heading")


case("p5_extract_projection", "part", "'## ' || p_name", lambda df: D.render_full(df, {"extract": {"headings": True, "links": False}}).select("doc_id", F.size("extracts.headings").alias("headings"), F.col("extracts.headings")[0]["id"].alias("id")), {"headings": "1", "id": SLUG("p_name")})

# -- aggregates, extracts

RICH = f"'# ' || p_name || {NL} || {NL} || 'Some words, [a link](/u \"t\") and ![an image](i.png).[^1]' || {NL} || {NL} || '```sql' || {NL} || 'select ' || p_size || {NL} || '```' || {NL} || {NL} || '[^1]: the note' || {NL}"
case("g1_statistics", "part", RICH, D.statistics, {"heading_count": "1", "code_block_count": "1", "image_count": "1", "link_count": "1", "footnote_definition_count": "1", "word_count": "2 + 7 + 2 + 2"})


@query("g1_statistics_relational", "SELECT p_partkey::BIGINT AS doc_id, 1 AS heading_count, 1 AS code_block_count, 1 AS image_count, 1 AS link_count, 1 AS footnote_definition_count FROM part")
def g1_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.statistics(D.parse_events(made(spark, sf_dir, "part", RICH), columns=R.TEXTS)).select("doc_id", "heading_count", "code_block_count", "image_count", "link_count", "footnote_definition_count")


case("g2_light_statistics", "part", OUTLINE, lambda df: D.render_full(df, {"toc": True}), {"heading_count": "3"})
case("g3_counted_text", "part", f"'a *' || p_name || '* c' || {NL} || 'd'", lambda df: R.counted_text(D.parse_events(df, columns=R.TEXTS)), {"text": "'a  ' || p_name || '  c  d '"})
case("g4_character_count", "part", "'a *' || p_name || '* c'", D.statistics, {"character_count": "length(p_name) + 6"})
scalar("g5_word_count", "part", lambda: {"words": S.word_count(F.concat_ws(" ", "p_name", "p_brand", F.lit("it's 3.5")))}, {"words": "length(p_name) - length(replace(p_name, ' ', '')) + 1 + 2 + 2"})
case("g6_heading_count", "part", f"'# ***' || {NL} || {NL} || '# ' || p_name || {NL} || {NL} || '> ## quoted'", D.statistics, {"heading_count": "2"})


@query("g7_language")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.detect_language(col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", found.alias("found")).select("doc_id", "lang", "found.code", "found.confidence")


case("g8_section_counts", "part", f"'# h' || {NL} || {NL} || p_name || {NL} || 'end'", lambda df: D.chunks_by_heading(df, {"statistics": True}), {"character_count": "length(p_name) + 5", "word_count": "3"})
case("g9_truncated_counts", "part", f"'# h' || {NL} || {NL} || 'two words' || {NL} || {NL} || repeat('long ', 40)", lambda df: D.chunks_by_heading(df, {"statistics": True}, {"chars": 20, "marker": None}), {"character_count": "9", "word_count": "2"})
case("g10_window_counts", "part", "'**' || p_name || '**'", lambda df: D.chunks_by_size(df, {"statistics": True}, chars=100), {"character_count": "length(p_name) + 4", "word_count": "2"})


@query("g11_toc_relational", f"SELECT p_partkey::BIGINT AS doc_id, '- [' || p_name || '](#' || {P} || ')' || {NL} || '  - [Size ' || p_size || '](#' || {Z} || ')' || {NL} || '  - [Size ' || p_size || '](#' || {Z} || '-1)' || {NL} AS toc_markdown FROM part")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.toc(R.headings(D.parse_events(made(spark, sf_dir, "part", OUTLINE), columns=R.HEADINGS)))


@query("g_corpus_rollup", "SELECT r_name, n_name, count(*)::BIGINT AS headings FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def g_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    docs = nations.selectExpr("r_name", "n_name", f"{NATION} AS source")
    return D.extract(docs, "headings").rollup("r_name", "n_name").agg(F.count("*").alias("headings"))


case("x1_images", "pages", "'![p' || page_id || '](' || url || ' \"t\")'", lambda df: D.extract(df, "images"), {"src": "url", "alt": "'p' || page_id", "title": "'t'", "byte_start": "0"})
case("x2_links", "pages", "'*[p' || page_id || '](' || url || ')*'", lambda df: D.extract(df, "links"), {"href": "url", "text": "'p' || page_id", "title": "''", "byte_start": "1"})
case("x2_links_relational", "pages", "'*[p' || page_id || '](' || url || ')*'", lambda df: R.element_text(D.parse_events(df), "link").withColumnRenamed("dest", "href"), {"href": "url", "text": "'p' || page_id", "byte_start": "1"})
case("x3_code_blocks", "part", RICH, lambda df: D.extract(df.withColumnRenamed("source", "md").withColumnRenamed("md", "source"), "code_blocks").withColumnRenamed("source", "code"), {"lang": "'sql'", "code": f"'select ' || p_size || {NL}"})
case("x4_headings", "part", "'## ' || p_name || ' `x`'", lambda df: D.extract(df, "headings"), {"level": "2", "text": "p_name || ' x'", "id": f"{SLUG('p_name')} || '-x'"})
case("x5_footnotes", "part", RICH, lambda df: D.extract(df, "footnote_definitions"), {"label": "'1'", "text": "'the note'"})
case("x6_implied_collection", "part", "'# ' || p_name", lambda df: D.render_full(df, {"statistics": True}), {"html": f"'<h1 id=\"' || {P} || '\">' || p_name || '</h1>' || {NL}", "toc_markdown": f"'- [' || p_name || '](#' || {P} || ')' || {NL}"})
case("x7_nothing_asked", "part", "'# ' || p_name", lambda df: D.render_full(df, "gfm").select("doc_id", F.col("toc_markdown").isNull().alias("no_toc"), F.col("statistics").isNull().alias("no_statistics")), {"no_toc": "true", "no_statistics": "true"})

# -- sections, windows, truncation

SECTION_SQL = f"""SELECT p_partkey::BIGINT AS doc_id, pos, CASE pos WHEN 0 THEN p_name ELSE 'Size ' || p_size END AS heading, CASE pos WHEN 0 THEN 1 ELSE 2 END AS level,
CASE pos WHEN 0 THEN {P} WHEN 1 THEN {Z} ELSE {Z} || '-1' END AS id, CASE pos WHEN 0 THEN '' ELSE p_name END AS path FROM part, (VALUES (0), (1), (2)) s(pos)"""


@query("w1_chunks_by_heading", SECTION_SQL.replace(" AS path", f" AS path, CASE pos WHEN 0 THEN 'a' || {NL} || {NL} || '## Size ' || p_size || {NL} || {NL} || 'b' || {NL} || {NL} || '## Size ' || p_size || {NL} || {NL} || 'c' WHEN 1 THEN 'b' ELSE 'c' END AS content"))
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunks_by_heading(made(spark, sf_dir, "part", OUTLINE)).select("doc_id", "pos", "heading", "level", "id", F.array_join("breadcrumb", "/").alias("path"), "content")


@query("w1_sections_relational", SECTION_SQL)
def w1_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = R.headings(D.parse_events(made(spark, sf_dir, "part", OUTLINE), columns=R.HEADINGS))
    return R.sections(heads).select("doc_id", (F.col("seq") / 6).cast("int").alias("pos"), "heading", "level", "id", F.array_join("breadcrumb", "/").alias("path"))


@query("w1b_preamble", "SELECT p_partkey::BIGINT AS doc_id, pos, CASE pos WHEN 1 THEN 'H' END AS heading, pos AS level, CASE pos WHEN 0 THEN p_name ELSE 'x' END AS content FROM part, (VALUES (0), (1)) s(pos)")
def w1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "part", f"p_name || {NL} || {NL} || '# H' || {NL} || {NL} || 'x'")
    return D.chunks_by_heading(docs).select("doc_id", "pos", "heading", "level", "content")


case("w1d_nested_slugs", "part", f"'> # ' || p_name || {NL} || {NL} || '# ' || p_name", lambda df: D.chunks_by_heading(df).where("heading IS NOT NULL"), {"id": f"{P} || '-1'"})
case("w1e_truncated_sections", "part", f"'# h' || {NL} || {NL} || p_name || {NL} || {NL} || repeat('long ', 40)", lambda df: D.chunks_by_heading(df, truncate={"chars": 60}), {"content": f"p_name || {NL} || {NL} || '…' || {NL}"})
case("w1f_filtered_heading_text", "part", "'# :rocket: ' || p_name || ' `c`'", lambda df: D.chunks_by_heading(df, {"emoji_shortcodes": True}), {"heading": "'🚀 ' || p_name || ' c'"})


@query("w2_chunks_by_size", f"SELECT p_partkey::BIGINT AS doc_id, i AS index, CASE i WHEN 0 THEN p_name || {NL} || {NL} || 'second block' ELSE repeat('x', 60) END AS content FROM part, (VALUES (0), (1)) s(i)")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "part", f"p_name || {NL} || {NL} || 'second block' || {NL} || {NL} || repeat('x', 60)")
    return D.chunks_by_size(docs, chars=64).select("doc_id", "index", "content")


@query("w2a_overlap", f"SELECT p_partkey::BIGINT AS doc_id, i AS index, CASE i WHEN 0 THEN repeat('x', 60) || 'tail' ELSE 'tail' || {NL} || {NL} || p_name END AS content FROM part, (VALUES (0), (1)) s(i)")
def w2a(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "part", f"repeat('x', 60) || 'tail' || {NL} || {NL} || p_name")
    return D.chunks_by_size(docs, chars=64, overlap=4).select("doc_id", "index", "content")


@query("w2b_word_windows", "SELECT p_partkey::BIGINT AS doc_id, i AS index, CASE i WHEN 0 THEN 'one two ' WHEN 1 THEN 'three' || p_size || ' four ' ELSE 'five' END AS content FROM part, (VALUES (0), (1), (2)) s(i)")
def w2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "part", "'one two three' || p_size || ' four five'")
    return D.chunks_by_size(docs, words=2, at="word").select("doc_id", "index", "content")


@query("w2b_documents_windows")
def w2b_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")))
    return D.chunks_by_size(docs, chars=2000, overlap=100).select("doc_id", "index", F.length("content").alias("chars"))


@query("w3_top_level_blocks", "SELECT p_partkey::BIGINT AS doc_id, 5::BIGINT AS blocks, 2::BIGINT AS deepest FROM part")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "part", f"'# ' || p_name || {NL} || {NL} || '---' || {NL} || {NL} || 'a' || {NL} || {NL} || '> b' || {NL} || {NL} || 'c'")
    events = R.with_depth(D.parse_events(docs, columns=("seq", "op")))
    return events.groupBy("doc_id").agg((F.max("block_ordinal") + 1).alias("blocks"), F.max("running_depth").alias("deepest"))


LONG = f"p_name || {NL} || {NL} || 'second block' || {NL} || {NL} || repeat('x', 60)"
CUT = f"p_name || {NL} || {NL} || 'second block' || {NL} || {NL} || '…' || {NL}"
case("l1a_truncate_blocks", "part", LONG, lambda df: D.truncate_markdown(df, chars=60), {"markdown": CUT})
case("l1a_truncate_relational", "part", LONG, lambda df: R.truncate_blocks(D.chunks_by_size(df, chars=1).withColumnsRenamed({"index": "block_id", "content": "markdown"}), 60), {"markdown": CUT})
case("l1b_truncate_words", "part", "p_name || ' and many more words'", lambda df: D.truncate_markdown(df, words=3, at="word"), {"markdown": "p_name || ' and…'"})


@query("l3_document_order", "SELECT doc_id, seq, kind FROM (SELECT n_nationkey::BIGINT AS doc_id, seq, kind FROM nation, (VALUES (0, 'heading'), (3, 'paragraph'), (4, 'strong'), (8, 'emphasis')) e(seq, kind)) ORDER BY 1, 2")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_events(made(spark, sf_dir, "nation", NATION)).where("op = 'start'").select("doc_id", "seq", "kind").orderBy("doc_id", "seq")


# -- joins and sets over events


case("j1_reference_links", "pages", f"'[p' || page_id || '][ref]' || {NL} || {NL} || '[REF]: ' || url", html(), {"html": p(A_HREF)})


@query("j2_emoji_dimension", "SELECT p_partkey::BIGINT AS doc_id, CASE WHEN p_size % 2 = 0 THEN '🚀' ELSE '🎉' END AS emoji FROM part")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("rocket", "🚀"), ("tada", "🎉")], "name string, emoji string")
    words = D.parse_events(made(spark, sf_dir, "part", "':' || CASE WHEN p_size % 2 = 0 THEN 'rocket' ELSE 'tada' END || ':'")).where("kind = 'text'")
    return words.withColumn("name", F.regexp_extract("text", ":([a-z]+):", 1)).join(F.broadcast(names), "name").select("doc_id", "emoji")


@query("j3_section_members", f"SELECT p_partkey::BIGINT AS doc_id, CASE s WHEN 0 THEN {P} WHEN 1 THEN {Z} ELSE {Z} || '-1' END AS section_id, CASE s WHEN 0 THEN 'a,Size ' || p_size || ',b,Size ' || p_size || ',c' WHEN 1 THEN 'b' ELSE 'c' END AS texts FROM part, (VALUES (0), (1), (2)) t(s)")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.parse_events(made(spark, sf_dir, "part", OUTLINE), columns=R.HEADINGS)
    members = R.section_members(events, R.sections(R.headings(events))).where("kind = 'text'")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ",")
    return members.groupBy("doc_id", "section_id").agg(texts.alias("texts"))


@query("j4_ancestors", "SELECT p_partkey::BIGINT AS doc_id, kind AS ancestor_kind, d AS ancestor_depth FROM part, (VALUES ('blockquote', 0), ('list', 1), ('list_item', 2), ('strong', 3)) a(kind, d)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.parse_events(made(spark, sf_dir, "part", "'> - **' || p_name || '**'"))
    return R.ancestors(events).where("kind = 'text'").select("doc_id", "ancestor_kind", "ancestor_depth")


@query("j5_unwrapped_links", f"SELECT page_id AS doc_id, sum(CASE WHEN {HOST} LIKE '%.com' THEN 5 ELSE 3 END)::BIGINT AS events FROM pages GROUP BY 1")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.parse_events(made(spark, sf_dir, "pages", LINK))
    left = R.unwrap(events, "link", ~S.is_host_allowed(col("dest"), ["*.com"]))
    return left.groupBy("doc_id").agg(F.count("*").alias("events"))


@query("s1_preamble_union", "SELECT p_partkey::BIGINT AS doc_id, 'H' AS heading FROM part UNION ALL SELECT p_partkey, NULL FROM part")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.chunks_by_heading(made(spark, sf_dir, "part", f"p_name || {NL} || {NL} || '# H' || {NL} || {NL} || 'x'"))
    return rows.where("level > 0").select("doc_id", "heading").unionByName(rows.where("level = 0").select("doc_id", "heading"))


@query("s2_hybrid_chunks", "SELECT p_partkey::BIGINT AS doc_id, h AS heading, i AS index, CASE WHEN h = 'Short' THEN p_name WHEN i = 0 THEN repeat('x', 50) ELSE repeat('y', 50) END AS content FROM part, (VALUES ('Short', 0), ('Long', 0), ('Long', 1)) t(h, i)")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, "part", f"'# Short' || {NL} || {NL} || p_name || {NL} || {NL} || '# Long' || {NL} || {NL} || repeat('x', 50) || {NL} || {NL} || repeat('y', 50)")
    return D.hybrid_chunks(docs, chars=60).select("doc_id", "heading", "index", "content")


# -- scalar functions

scalar("sc1_slugify", "part", lambda: {"slug": S.slugify(F.concat_ws(" ", "p_name", "p_brand", F.lit("é!"))), "ascii": S.slugify_ascii(F.concat_ws(" ", "p_name", "p_brand"))}, {"slug": SLUG("p_name || ' ' || p_brand") + " || '-e'", "ascii": SLUG("p_name || ' ' || p_brand")})
scalar("sc2_replace_emoji", "part", lambda: {"out": S.replace_emoji(F.concat("p_name", F.lit(" :+1: :x")))}, {"out": "p_name || ' 👍 :x'"})
scalar("sc3_tagfilter", "pages", lambda: {"out": S.tagfilter(col("html"))}, {"out": "regexp_replace(html, '(?i)<(/?(title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)([ \\t\\r\\n>]|/>))', '&lt;\\1', 'g')"})
scalar("sc4_host_allowed", "pages", lambda: {"none": S.is_host_allowed(col("url"), []), "any": S.is_host_allowed(col("url"), ["*"])}, {"none": "false", "any": "true"})
scalar("sc5_scheme_allowed", "pages", lambda: {"ok": S.is_scheme_allowed(col("url"), ["http"])}, {"ok": "url LIKE 'http:%'"})
scalar("sc6_external", "pages", lambda: {"ok": S.is_external(F.upper("url"))}, {"ok": "true"})
scalar("sc7_escape", "pages", lambda: {"text": S.escape_text(col("html")), "attribute": S.escape_attribute(col("html"))}, {"text": "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "attribute": "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"})
scalar("sc8_escape_href", "pages", lambda: {"href": S.escape_href(F.concat("url", F.lit("?a b&c")))}, {"href": "replace(url, '&', '&amp;') || '?a%20b&amp;c'"})
scalar("sc9_img_tag", "part", lambda: {"tag": S.img_tag(F.lit("i.png"), col("p_name"), F.lit("t"))}, {"tag": "'<img src=\"i.png\" alt=\"' || p_name || '\" title=\"t\" loading=\"lazy\" decoding=\"async\" />'"})
scalar("sc10_link_open", "pages", lambda: {"tag": S.link_open(col("url"), F.lit(""))}, {"tag": "'<a href=\"' || replace(url, '&', '&amp;') || '\" rel=\"nofollow noopener\">'"})
scalar("sc11_counts", "part", lambda: {"chars": S.char_count(F.concat(F.lit(" \u00a0"), "p_name", F.lit("\n"))), "words": S.word_count(col("p_name"))}, {"chars": "length(p_name)", "words": "length(p_name) - length(replace(p_name, ' ', '')) + 1"})
scalar("sc12_prefix_lines", "part", lambda: {"out": S.prefix_lines(F.concat("p_name", F.lit("\n\nx")), "> ")}, {"out": f"'> ' || p_name || {NL} || '>' || {NL} || '> x'"})
scalar("sc13_detect_language", "part", lambda: {"code": S.detect_language(F.concat(F.lit("the end of the "), "p_name"))["code"]}, {"code": "'eng'"})


@query("sc14_highlight")
def sc14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), S.highlight_code(F.concat(F.lit("SELECT "), F.col("p_size").cast("string")), "sql").alias("html"))


scalar("sc15_toc_escape", "part", lambda: {"out": S.toc_escape(F.concat(F.lit("["), "p_name", F.lit("]")))}, {"out": "'\\[' || p_name || '\\]'"})
scalar("sc16_breadcrumb_path", "part", lambda: {"path": S.breadcrumb_path(F.array("p_type", "p_brand"), col("p_name"))}, {"path": "p_type || ' > ' || p_brand || ' > ' || p_name"})
scalar("sc17_yaml_variant", "part", lambda: {"size": F.variant_get(S.yaml_variant(F.concat(F.lit("a: {b: "), F.col("p_size").cast("string"), F.lit("}"))), "$.a.b", "int")}, {"size": "p_size"})
scalar("sc18_byte_slice", "part", lambda: {"out": S.byte_slice(F.concat(F.lit("é"), "p_name"), F.lit(2), F.lit(2) + F.length("p_name"))}, {"out": "p_name"})

# -- handlers


def shouted(e: object) -> None:
    e.markdown = e.text.upper()


def handlers() -> Handlers:
    on = Handlers()

    def lower(e: object) -> None:
        e.level = e.level + 1

    def secure(e: object) -> None:
        e.dest = e.dest.replace("http://", "https://")

    return on.on("heading", lower).on("link", secure).on("image", lambda e: e.delete()).on("emphasis", shouted)


case("u1_handlers", "pages", f"'# h' || {NL} || {NL} || " + LINK + " || ' *x* ![i](y)'", lambda df: D.to_html_with(df, handlers()), {"html": f"'<h2>h</h2>' || {NL} || '<p><a href=\"' || replace(replace(url, 'http://', 'https://'), '&', '&amp;') || '\">p' || page_id || '</a> ' || {NL} || '<p>X</p>' || {NL} || ' </p>' || {NL}"})


@query("u2_walk", "SELECT p_partkey::BIGINT AS doc_id, seq, kind, value FROM part, LATERAL (SELECT * FROM (VALUES (0, 'strong', p_name), (1, 'paragraph', 'a ' || p_name), (2, 'heading', 'T')) w(seq, kind, value))")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = Handlers()
    for kind in ("strong", "paragraph", "heading"):
        on.on(kind, lambda e: e.text)
    return D.walk(made(spark, sf_dir, "part", f"'a **' || p_name || '**' || {NL} || {NL} || '# T'"), on).select("doc_id", "seq", "kind", "value")


@query("u5_post_order", "SELECT p_partkey::BIGINT AS doc_id, seq, kind, parents FROM part, (VALUES (0, 'text', 'strong/list_item/list'), (1, 'strong', 'list_item/list'), (2, 'list_item', 'list'), (3, 'list', '')) w(seq, kind, parents)")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = Handlers()
    for kind in ("list", "list_item", "strong", "text"):
        on.on(kind, lambda e: None)
    return D.walk(made(spark, sf_dir, "part", "'- **' || p_name || '**'"), on).select("doc_id", "seq", "kind", F.array_join("ancestor_kinds", "/").alias("parents"))


def html_for_code(e: object) -> None:
    e.html = f"<kbd>{e.text}</kbd>"


case("u6_html_mutation", "part", "'press `' || p_name || '`'", lambda df: D.to_html_with(df, Handlers().on("code", html_for_code)), {"html": p("'press <kbd>' || p_name || '</kbd>'")})
case("u7_markdown_mutation", "part", "p_name", lambda df: D.to_html_with(df, Handlers().on("paragraph", lambda e: setattr(e, "markdown", f"# {e.text}"))), {"html": f"'<h1>' || p_name || '</h1>' || {NL}"})
case("u9_container_text", "part", f"'a `b` *' || p_name || '*' || {NL} || 'c'", lambda df: D.walk(df, Handlers().on("paragraph", lambda e: e.text)), {"value": "'a b ' || p_name || 'c'"})


case("u3_handlers_then_filters", "pages", LINK, lambda df: D.to_html_with(df, Handlers().on("link", lambda e: setattr(e, "title", "t")), {"links": {"nofollow": True}}), {"html": p("'<a href=\"' || replace(url, '&', '&amp;') || '\" title=\"t\" rel=\"nofollow noopener\">p' || page_id || '</a>'")})
case("u4_element_source", "part", "'x **' || p_name || '** y'", lambda df: D.walk(df, Handlers().on("strong", lambda e: e.source)), {"value": "'**' || p_name || '**'"})
case("u8_event_fields", "part", "'> x *' || p_name || '*'", lambda df: D.walk(df, Handlers().on("emphasis", lambda e: f"{e.byte_range}{[c.kind for c in e.children]}")), {"value": "'(4, ' || (6 + length(p_name)) || ')[''text'']'", "depth": "2", "parent_kind": "'paragraph'"})
case("w1a_boundaries", "part", f"'- # ' || p_name || {NL} || {NL} || '# ' || p_name || {NL} || {NL} || '> ## q'", lambda df: R.sections(R.headings(D.parse_events(df, columns=R.HEADINGS))), {"heading": "p_name", "id": f"{P} || '-1'"})
case("w1c_breadcrumb", "part", f"'# ' || p_name || {NL} || {NL} || '### deep' || {NL} || {NL} || 'x'", lambda df: R.sections(R.headings(D.parse_events(df, columns=R.HEADINGS))).where("level = 3").withColumn("path", F.array_join("breadcrumb", "/")), {"path": "p_name", "heading": "'deep'"})


@query("t1_table_functions", f"SELECT p_partkey::BIGINT AS doc_id, i AS index, CASE i WHEN 0 THEN p_name || {NL} || {NL} || 'second block' ELSE repeat('x', 60) END AS content FROM part, (VALUES (0), (1)) s(i)")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.register(spark)
    made(spark, sf_dir, "part", LONG).createOrReplaceTempView("md_docs")
    return spark.sql("SELECT doc_id, w.index, w.content FROM md_docs, LATERAL md_chunks_by_size(source, 64, 0) w")


@query("t1_sql_functions", f"SELECT p_partkey::BIGINT AS doc_id, '<h1>' || p_name || '</h1>' || {NL} AS html, p_name || {NL} AS plain_text, {SLUG('p_name')} AS slug FROM part")
def t1_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.register(spark)
    made(spark, sf_dir, "part", "'# ' || p_name").createOrReplaceTempView("md_titles")
    return spark.sql("SELECT doc_id, md_to_html(source) AS html, md_to_plain_text(source) AS plain_text, md_slugify(source) AS slug FROM md_titles")


@query("o1_presets", "SELECT * FROM (VALUES ('commonmark', false, false), ('gfm', true, false), ('recommended', true, false), ('trusted', true, true)) o(preset, tables, raw_html)")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, Options.of(preset=n)["tables"], Options.of(preset=n)["raw_html"]) for n in ("commonmark", "gfm", "recommended", "trusted")]
    return spark.createDataFrame(rows, "preset string, tables boolean, raw_html boolean")


@query("o6_validation", "SELECT * FROM (VALUES ('no budget', true), ('bad at', true), ('long marker', true), ('overlap', true), ('unknown option', true), ('toc depth', true), ('good', false)) o(name, raises)")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries: dict[str, Callable[[], object]] = {
        "no budget": Truncate, "bad at": lambda: Truncate(chars=9, at="line"), "long marker": lambda: Truncate(chars=3, marker="[cut]"),
        "overlap": lambda: Windows(chars=5, overlap=5), "unknown option": lambda: Options.of(taples=True), "toc depth": lambda: Options.of(toc={"depth": 9}),
        "good": lambda: Windows(chars=5, overlap=4),
    }

    def raises(f: Callable[[], object]) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(n, raises(f)) for n, f in tries.items()], "name string, raises boolean")


@query("html_fragments_relational", SQL["snk1_to_html"])
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.html_fragments(D.parse_events(made(spark, sf_dir, "nation", NATION)))


@query("stream_to_html", f"SELECT n_nationkey::BIGINT AS doc_id, '<h1>' || n_name || '</h1>' || {NL} || '<p><strong>nation</strong> of <em>the</em> <code>world</code></p>' || {NL} AS html FROM nation")
def stream_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "nation").schema
    stream = batches.parquet_stream(spark, sf_dir, "nation", schema).selectExpr("cast(n_nationkey AS long) AS doc_id", f"{NATION} AS source")
    return batches.run_once(D.to_html(stream))
