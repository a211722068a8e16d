"""The parser and the sinks, on short inputs with outputs known from the CommonMark rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markloom.kernel.chunks import chunks_by_heading, chunks_by_size, truncate_markdown
from markloom.kernel.collect import counted_text, counts, extracts, heading_rows, statistics, toc
from markloom.kernel.events import matching_end
from markloom.kernel.filters import apply, content, img_tag, tag_filter
from markloom.kernel.handlers import Handlers, to_html_with
from markloom.kernel.html import to_html
from markloom.kernel.markdown import to_markdown
from markloom.kernel.options import Options, Truncate, Windows, resolve
from markloom.kernel.parse import parse
from markloom.kernel.plain import to_plain_text
from markloom.kernel.words import count_words, host_allowed, is_external, replace_emoji, scheme_allowed, slugify


def html(source, **options):
    o = Options.of(**options)
    return to_html(apply(parse(source, o.syntax()), o))


def md(source, **options):
    o = Options.of(**options)
    return to_markdown(apply(content(parse(source, o.syntax())), o))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("# Hello", "<h1>Hello</h1>\n"),
        ("Title\n---", "<h2>Title</h2>\n"),
        ("*a **b** c*", "<p><em>a <strong>b</strong> c</em></p>\n"),
        ("a\\\nb  \nc", "<p>a<br />\nb<br />\nc</p>\n"),
        ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
        ("- a\n  - b", "<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ul>\n"),
        ("3) x", '<ol start="3">\n<li>x</li>\n</ol>\n'),
        ("> a\nb", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n"),
        ("\tcode\n\n\tmore", "<pre><code>code\n\nmore\n</code></pre>\n"),
        ("~~~ py x\n<&\n~~~", '<pre><code class="language-py">&lt;&amp;\n</code></pre>\n'),
        ("[a](<b c> \"t\")", '<p><a href="b%20c" title="t">a</a></p>\n'),
        ("[x][Y]\n\n[y]: /u 'q'", '<p><a href="/u" title="q">x</a></p>\n'),
        ("![a *b*](c)", '<p><img src="c" alt="a b" /></p>\n'),
        ("<http://a.b>", '<p><a href="http://a.b">http://a.b</a></p>\n'),
        ("&copy; &#35; &nosuch;", "<p>© # &amp;nosuch;</p>\n"),
        ("`` a`b ``", "<p><code>a`b</code></p>\n"),
        ("snake_case_word", "<p>snake_case_word</p>\n"),
        ("***", "<hr />\n"),
        ('say "hi"', '<p>say "hi"</p>\n'),
        ("|a|b|\n|-|-|\n|1|", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody>\n<tr><td>1</td><td></td></tr>\n</tbody></table>\n"),
        ("", ""),
        ("\n \n", ""),
    ],
)
def test_html(source, expected):
    assert html(source) == expected


def test_extensions_can_be_off():
    assert html("~~x~~", strikethrough=False) == "<p>~~x~~</p>\n"
    assert "<table>" not in html("|a|\n|-|", tables=False)
    assert "checkbox" not in html("- [ ] a", tasklists=False)
    assert "footnote" not in html("a[^1]\n\n[^1]: b", footnotes=False)
    assert "alert" not in html("> [!NOTE]\n> a", gfm=False)


def test_filters_in_order():
    assert html("# :rocket: Launch", emoji_shortcodes=True, headings={"ids": True}) == '<h1 id="rocket-launch">🚀 Launch</h1>\n'
    assert html("[a](http://x.com)", links={"nofollow": True, "allowed_hosts": []}) == "<p>a</p>\n"
    assert html("see https://e.net.", links={"autolink": True}) == '<p>see <a href="https://e.net">https://e.net</a>.</p>\n'
    assert html("me@e.net", links={"autolink": True, "allowed_hosts": []}) == '<p><a href="mailto:me@e.net">me@e.net</a></p>\n'
    assert html("<scripter>", raw_html=True) == "<scripter>\n"
    assert "span" in html("```python\nx = 1\n\n```", syntax_highlight=True)


def test_heading_ids_number_by_base_and_may_collide():
    assert [h["id"] for h in heading_rows(parse("# Intro\n# Intro\n# Intro 1\n# !"))] == ["intro", "intro-1", "intro-1"]
    out = html("# Foo {#custom}\n# Foo", headings={"ids": True, "attributes": True})
    assert 'id="custom"' in out and 'id="foo"' in out


def test_markdown_sink():
    assert md("**bold**") == "**bold**"
    assert md("# foo *bar*", headings={"ids": True}) == "# foo *bar* { #foo-bar }"
    assert md("![foo ![bar](/u)](/v)", images={"lazy": True}) == '<img src="/v" alt="foo bar" loading="lazy" decoding="async" />'
    assert md("**[text\n](https://evil.com)**", links={"allowed_hosts": []}) == "**text**"
    assert md("https://e.net", links={"autolink": True}) == "<https://e.net>"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("> first\n>\n> second", "> first\n>\n> second\n"),
        ("> > nested", "> > nested\n"),
        ("- outer\n  - inner", "- outer\n  - inner\n"),
        ("- [x] done\n- [ ] todo", "- done\n- todo\n"),
        ("|a|b|\n|-|-|\n|1|2|\n|3|4|", "a\tb\n\n1\t2\n3\t4\n"),
        ("See[^x].\n\n[^x]: body text", "See[x].\n\n[x]: body text\n"),
        ("[e](https://e.net) <https://e.net> ![c](d)", "e (https://e.net) https://e.net c (d)\n"),
    ],
)
def test_plain_text(source, expected):
    assert to_plain_text(parse(source)) == expected


def test_statistics_and_extracts():
    source = "# Title\n\nProse word.\n\n```\ncode tokens here\n```\n"
    assert statistics(parse(source))["word_count"] == 6
    assert counts(counted_text(parse("a *b* c"))) == (7, 3)
    found = extracts(parse('é [x](y "t") ![a ![b](c)](d)\n\n[^n]: *one* two\n'))
    raw = 'é [x](y "t")'.encode()
    (link,) = found["links"]
    assert raw[link["byte_start"] : link["byte_end"]] == b'[x](y "t")'
    assert [i["src"] for i in found["images"]] == ["c"]  # the inner image takes the place of the outer
    assert found["footnote_definitions"][0]["text"] == "one  two"


def test_toc():
    rows = [{"level": 2, "text": "A [1]", "id": "a-1"}, {"level": 2, "text": "B", "id": "b"}]
    markdown, out = toc(rows)
    assert markdown == "- [A \\[1\\]](#a-1)\n- [B](#b)\n"
    assert out.count("<ul>") == 2 == out.count("</ul>")


def test_sections_and_windows():
    o = Options.of()
    source = "p\n\n# A\n\n## B\n\nx\n\n# C\n\n> # D\n"
    rows = chunks_by_heading(source, o)
    assert [(r["heading"], r["level"], r["breadcrumb"]) for r in rows] == [(None, 0, []), ("A", 1, []), ("B", 2, ["A"]), ("C", 1, [])]
    assert [r["heading"] for r in chunks_by_heading("---\n\n# A", o)] == ["A"]
    assert len(chunks_by_size("a " * 500, Windows(chars=200), o)) == 1
    words = chunks_by_size("one two three four", Windows(words=2, at="word"), o)
    assert "".join(r["content"] for r in words) == "one two three four"
    assert truncate_markdown("a " * 500, Truncate(chars=50), o) == ""
    assert truncate_markdown("one\n\n" + "two " * 30, Truncate(chars=50), o) == "one\n\n…\n"
    assert len(truncate_markdown("one two three four", Truncate(chars=10, at="word"), o)) <= 10


def test_handlers_precedence_and_level():
    def change(e):
        e.level, e.html = 9, "<x>"

    assert "<x>" in to_html_with("# a", Handlers().on("heading", change), Options.of())
    assert to_html_with("# a", Handlers().on("heading", change).on("heading", lambda e: e.delete()), Options.of()) == ""
    assert to_html_with("# a", Handlers().on("heading", lambda e: setattr(e, "level", 9)), Options.of()) == "<h6>a</h6>\n"
    assert "<ol>" in to_html_with("3. a", Handlers().on("text", lambda e: None), Options.of())


def test_scalars():
    assert slugify("Лев Толстой") == "lev-tolstoi" and slugify("Résumé") == "resume" and slugify("a -- b!") == "a-b"
    assert replace_emoji(":tada: :Rocket: 8:00:rocket:") == "🎉 :Rocket: 8:00🚀"
    assert tag_filter("<SCRIPT><script/ok><iframe/></title>") == "&lt;SCRIPT><script/ok>&lt;iframe/>&lt;/title>"
    assert host_allowed("https://a.b.example.net/x", ("*.example.net",)) and not host_allowed("https://example.net", ("*.example.net",))
    assert host_allowed("/relative", ()) and not host_allowed("https://EXAMPLE.net", ("EXAMPLE.net",))
    assert scheme_allowed("//cdn/x", ()) and not scheme_allowed(" java\nscript:x", ("http",))
    assert is_external("HTTPS://x") and not is_external("mailto:x")
    assert count_words("it's 3.5 can't—stop") == 4
    assert img_tag("i.png", 'a"', "") == '<img src="i.png" alt="a&quot;" loading="lazy" decoding="async" />'


@pytest.mark.parametrize(
    "bad",
    [{"taples": True}, {"tables": 1}, {"toc": {"depth": 0}}, {"toc": {"deep": 1}}, {"extract": {"x": True}}, {"extract": {"links": 1}}, {"links": {"x": 1}}, {"images": {"lazy": 1}}, {"links": True}, {"preset": "x"}],
)
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Options.of(**bad)


def test_options_merge_compare_and_resolve():
    o = Options.of(preset="recommended", links={"autolink": False})
    assert o["links"]["nofollow"] and not o["links"]["autolink"]
    assert Options.of(tables=False) == Options.of().merge(tables=False) != Options.of()
    assert resolve({"tables": False})["tables"] is False
    with pytest.raises(TypeError):
        resolve(3)
    with pytest.raises(ValueError):
        Truncate(chars=1, marker="..")
    with pytest.raises(ValueError):
        Windows(chars=5, overlap=5)


def test_process_defaults_are_copied_on_write(monkeypatch):
    from markloom.kernel import options as module

    monkeypatch.setattr(module, "_default", module._default)
    before = module.default_options()
    module.configure(hard_wrap=True, toc={"depth": 2})
    assert resolve(None)["hard_wrap"] and resolve(None).toc_depth == 2 and not before["hard_wrap"]
    assert resolve(None).merge(toc=False).toc_depth == 2
    full = Options.of(statistics=True).collecting()
    assert full.toc and full["headings"]["ids"] and full["extract"] == {"headings": True}
    assert set(Options.of().to_dict()) >= {"tables", "links", "toc", "extract"}


MARKS = st.text(alphabet="ab \n*_`[]()<>#-+1.|~!\\&>\t:", max_size=60)


@settings(max_examples=200, deadline=None)
@given(MARKS)
def test_any_text_parses_to_balanced_events(source):
    events = parse(source)
    depth = 0
    for i, e in enumerate(events):
        depth += (e.op == "start") - (e.op == "end")
        assert depth >= 0
        if e.op == "start":
            assert events[matching_end(events, i)].kind == e.kind
        assert 0 <= e.start <= len(source.encode())
    assert depth == 0
    to_html(events), to_markdown(events), to_plain_text(events)
