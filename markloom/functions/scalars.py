"""Scalar functions: built-in expressions where Spark has them, Arrow UDFs where it does not."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import chunks, collect, filters, highlight, html, markdown, plain, words
from ..kernel.options import Truncate, resolve
from ..kernel.parse import parse

# -- built-in expressions


def escape_text(x: Column) -> Column:
    """For HTML text nodes: quotes stay."""
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(x: Column) -> Column:
    return F.replace(escape_text(x), F.lit('"'), F.lit("&quot;"))


def trim_all(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def slugify_ascii(x: Column) -> Column:
    """slugify() of ASCII text."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def tagfilter(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?i)<(?=/?(?:{'|'.join(filters.BARRED)})(?:[ \t\r\n>]|/>))", "&lt;")


def is_external(url: Column) -> Column:
    return F.coalesce((F.instr(url, "://") > 0) & F.lower(F.substring_index(url, "://", 1)).isin("http", "https"), F.lit(False))


def scheme(url: Column) -> Column:
    """The lower-case scheme of an absolute URL, else null."""
    plain_url = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    found = F.lower(F.regexp_extract(plain_url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(found != "", found)


def is_scheme_allowed(url: Column, schemes: list[str]) -> Column:
    s = scheme(url)
    return F.when(s.isNull(), True).otherwise(s.isin([x.lower() for x in schemes]) if schemes else F.lit(False))


def toc_escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\\[\]])", r"\\$1")


def prefix_lines(x: Column, prefix: str) -> Column:
    """Every line with the prefix; empty lines with the bare one."""
    return F.array_join(F.transform(F.split(x, "\n"), lambda y: F.when(y == "", prefix.rstrip()).otherwise(F.concat(F.lit(prefix), y))), "\n")


def byte_slice(x: Column, start: Column, end: Column) -> Column:
    """The part of a string in an exclusive range of its UTF-8 bytes."""
    return F.decode(F.substring(F.encode(x, "UTF-8"), start + 1, end - start), "UTF-8")


def char_count(x: Column) -> Column:
    return F.length(trim_all(x))


def img_tag(src: Column, alt: Column, title: Column) -> Column:
    name = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' title="'), escape_attribute(title), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<img src="'), escape_href(src), F.lit('" alt="'), escape_attribute(alt), F.lit('"'), name, F.lit(' loading="lazy" decoding="async" />'))


def link_open(href: Column, title: Column) -> Column:
    name = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' title="'), escape_attribute(title), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<a href="'), escape_href(href), F.lit('"'), name, F.lit(' rel="nofollow noopener">'))


def breadcrumb_path(crumbs: Column, heading: Column) -> Column:
    """Breadcrumbs and the heading as one path."""
    return F.array_join(F.concat(crumbs, F.array(heading)), " > ")


# -- Arrow UDFs


def mapped(make: Callable[[str], object], kind: str) -> Callable[..., Column]:
    """A function of one string; null stays null."""
    arrow, result = {"string": (pa.string(), T.StringType()), "int": (pa.int32(), T.IntegerType()), "boolean": (pa.bool_(), T.BooleanType())}[kind]

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else make(s) for s in x.to_pylist()], arrow)

    return F.arrow_udf(run, result)


slugify = mapped(words.slugify, "string")
replace_emoji = mapped(words.replace_emoji, "string")
word_count = mapped(words.count_words, "int")
escape_href = mapped(html.escape_href, "string")
yaml_json = mapped(collect.frontmatter_json, "string")


def is_host_allowed(url: Column, globs: list[str]) -> Column:
    given = tuple(globs)
    words.host_pattern(given)
    return mapped(lambda s: words.host_allowed(s, given), "boolean")(url)


def highlight_code(code: Column, lang: str) -> Column:
    return mapped(lambda s: highlight.highlighted(s, lang), "string")(code)


def languages(x: pa.Array) -> pa.Array:
    rows = [None if s is None else dict(zip(("code", "confidence"), words.detect_language(s), strict=True)) for s in x.to_pylist()]
    return pa.array(rows, pa.struct([("code", pa.string()), ("confidence", pa.float64())]))


detect_language = F.arrow_udf(languages, T.StructType().add("code", T.StringType()).add("confidence", T.DoubleType()))


def yaml_variant(x: Column) -> Column:
    return F.parse_json(yaml_json(x))


# -- SQL names


def html_of(source: str) -> str:
    return html.to_html(filters.apply(parse(source), resolve("gfm")))


def register(spark: SparkSession) -> None:
    """SQL functions md_*, and table functions for LATERAL joins."""
    o = resolve(None)
    for name, make, kind in (
        ("md_to_html", lambda s: html.to_html(filters.apply(parse(s, o.syntax()), o)), "string"),
        ("md_to_markdown", lambda s: markdown.to_markdown(chunks.filtered(s, o)), "string"),
        ("md_to_plain_text", lambda s: plain.to_plain_text(chunks.filtered(s, o)), "string"),
        ("md_slugify", words.slugify, "string"),
        ("md_replace_emoji", words.replace_emoji, "string"),
        ("md_tagfilter", filters.tag_filter, "string"),
        ("md_word_count", words.count_words, "int"),
        ("md_is_external", words.is_external, "boolean"),
        ("md_escape_href", html.escape_href, "string"),
        ("md_truncate_60", lambda s: chunks.truncate_markdown(s, Truncate(chars=60), o), "string"),
    ):
        spark.udf.register(name, mapped(make, kind))
    spark.udf.register("md_detect_language", detect_language)

    @F.udtf(returnType="index int, content string")
    class Windows:
        def eval(self, source: str, chars: int, overlap: int):  # noqa: ANN202
            from markloom.kernel.options import Windows as Window

            for row in chunks.chunks_by_size(source or "", Window(chars=chars, overlap=overlap), o):
                yield row["index"], row["content"]

    @F.udtf(returnType="pos int, heading string, level int, id string, content string")
    class Sections:
        def eval(self, source: str):  # noqa: ANN202
            for i, row in enumerate(chunks.chunks_by_heading(source or "", o)):
                yield i, row["heading"], row["level"], row["id"], row["content"]

    spark.udtf.register("md_chunks_by_size", Windows)
    spark.udtf.register("md_chunks_by_heading", Sections)
