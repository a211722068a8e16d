"""Deep and long documents, and scripts beyond Latin."""

import time

import pytest

from markloom.kernel import chunks, handlers, options, words
from markloom.kernel.html import to_html
from markloom.kernel.markdown import to_markdown
from markloom.kernel.parse import parse
from markloom.kernel.plain import to_plain_text


def test_deep_nesting_does_not_fail():
    o = options.Options.of()
    quotes = chunks.filtered(">" * 10_000, o)
    assert sum(e.op == "start" for e in quotes) == 10_000
    assert to_html(quotes).count("<blockquote>") == 10_000 and to_plain_text(quotes) == to_plain_text(quotes)
    lists = "".join("  " * i + "- a\n" for i in range(300))
    assert to_html(chunks.filtered(lists, o)).count("<li>") == 300
    assert to_markdown(chunks.filtered("> " * 1500 + "x", o)).endswith("x")
    seen = []
    handlers.to_html_with("> " * 1500 + "x", handlers.Handlers().on("blockquote", lambda e: seen.append(e.text)), o)
    assert seen == ["x"] * 1500


@pytest.mark.parametrize("make", [
    lambda n: lambda: parse("".join(f"[a{i}]: /u\n" for i in range(10 * n))),
    lambda n: lambda: chunks.chunks_by_size("word other thing. " * n, options.Windows(words=50, at="word", overlap=10), options.Options.of()),
])
def test_time_grows_with_the_text(make):
    def seconds(n):
        run, best = make(n), 1e9
        for _ in range(3):
            began = time.process_time()
            run()
            best = min(best, time.process_time() - began)
        return best

    assert seconds(4000) < 8 * seconds(1000) + 0.2  # a quadratic step would take 16 times


def test_word_windows_cover_and_overlap():
    o = options.Options.of()
    text = " ".join(f"w{i}" for i in range(40))
    whole = [x["content"] for x in chunks.chunks_by_size(text, options.Windows(words=7, at="word"), o)]
    assert "".join(whole).strip() == text and all(words.count_words(x) <= 7 for x in whole)
    over = [x["content"] for x in chunks.chunks_by_size(text, options.Windows(chars=30, at="word", overlap=6), o)]
    assert all(len(x) <= 30 for x in over) and all(a[-3:].strip() in b for a, b in zip(over, over[1:], strict=False))


@pytest.mark.parametrize(("text", "slug"), [
    ("中文", "zhong-wen"), ("Hello 中文 World", "hello-zhong-wen-world"), ("Αθήνα", "athena"), ("ελληνικά", "ellenika"), ("½ cup", "1-2-cup"),
    ("Лев Толстой", "lev-tolstoi"), ("Санкт-Петербург", "sankt-peterburg"), ("Résumé", "resume"), ("naïve", "naive"), ("سلام", "slam"), ("नमस्ते", "nmste"),
])
def test_slugs_of_other_scripts(text, slug):
    assert words.slugify(text) == slug


@pytest.mark.parametrize(("text", "code"), [
    ("Questa è una frase molto lunga che non dice niente della vita", "ita"), ("Isto não é uma frase muito boa para você", "por"),
    ("Dit is een zin die niet veel zegt over het leven", "nld"), ("Это предложение на русском", "rus"), ("これは日本語の文です", "jpn"),
    ("这是中文句子", "cmn"), ("한국어 문장입니다", "kor"), ("Це українська мова", "ukr"), ("the end of the", "eng"), ("der Hund und die Katze", "deu"), ("12 34", None),
])
def test_languages(text, code):
    assert words.detect_language(text)[0] == code


def test_shortcodes():
    for name in ("us", "smirk", "de", "stuck_out_tongue", "kissing_heart", "hankey", "cop", "e-mail", "o", "white_flag", "santa", "tada"):
        assert words.emoji(name), name
    assert words.emoji("us") == "\U0001f1fa\U0001f1f8" and words.emoji("no_such_name") is None


@pytest.mark.parametrize("wrong", [
    {}, {"chars": True}, {"words": "3"}, {"chars": 9, "at": "line"}, {"chars": 0}, {"words": -1}, {"chars": 5, "overlap": 5}, {"chars": 5, "overlap": -1}, {"chars": 5, "overlap": 1.5},
])
def test_wrong_windows(wrong):
    with pytest.raises(ValueError):
        options.Windows(**wrong)


def test_wrong_truncations():
    for wrong in ({}, {"chars": 9.5}, {"chars": 3, "marker": "[cut]"}, {"chars": 3, "marker": 5}, {"chars": 3, "at": "char"}):
        with pytest.raises(ValueError):
            options.Truncate(**wrong)
    with pytest.raises(ValueError):
        options.Truncate.of({"chars": 3, "size": 1})
    with pytest.raises(TypeError):
        options.Truncate.of(3)
    assert options.Truncate.of({"chars": 1, "marker": None}).chars == 1
