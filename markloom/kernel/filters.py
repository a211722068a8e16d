"""Filters over events, in their fixed order."""

from __future__ import annotations

import re
from collections.abc import Callable

from .events import Event, inner_text, matching_end
from .highlight import highlighted
from .html import escape, escape_href
from .options import Options
from .words import Slugs, host_allowed, host_pattern, is_external, replace_emoji, scheme_allowed

#: Tags that the GFM tag filter disarms.
BARRED = "title textarea style xmp iframe noembed noframes script plaintext".split()
BARRED_TAG = re.compile(rf"<(?=/?(?:{'|'.join(BARRED)})(?:[ \t\r\n>]|/>))", re.I)
FOUND = re.compile(
    r"(?P<url>(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"\x00-\x1f`]+)|(?P<mail>[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
)


def tag_filter(html: str) -> str:
    return BARRED_TAG.sub("&lt;", html)


def url_end(url: str) -> str:
    """A found URL without the punctuation and unbalanced closing marks that follow it."""
    pairs = {")": "(", "]": "[", "}": "{"}
    while url:
        c = url[-1]
        if c in ".,:;?!'\"*_~" or c in pairs and url.count(c) > url.count(pairs[c]):
            url = url[:-1]
        else:
            break
    return url


def autolinked(e: Event) -> list[Event]:
    """A text event with the bare URLs and addresses in it as links."""
    out, at, text = [], 0, e.text
    for m in FOUND.finditer(text):
        if m.start() < at:
            continue
        mail = m["mail"]
        found = mail or url_end(m["url"])
        if not mail and not found.partition("://")[2]:
            continue
        if m.start() > at:
            out.append(e.but(text=text[at : m.start()]))
        kind = "email" if mail else "autolink"
        out += [Event("start", "link", dest=found, title="", link_type=kind, start=e.start, end=e.end), e.but(text=found), Event("end", "link")]
        at = m.start() + len(found)
    return [e] if not at else out + ([e.but(text=text[at:])] if at < len(text) else [])


def texts(events: list[Event], change: Callable[[Event], list[Event]], barred: tuple[str, ...]) -> list[Event]:
    """Applies `change` to text events that are not inside the barred containers."""
    out, inside = [], 0
    for e in events:
        if e.kind in barred and e.op != "leaf":
            inside += 1 if e.op == "start" else -1
        out += change(e) if e.kind == "text" and not inside else [e]
    return out


def heading_ids(events: list[Event]) -> list[Event]:
    slugs, out = Slugs(), list(events)
    for i, e in enumerate(events):
        if e.kind == "heading" and e.op == "start" and e.id is None:
            slug = slugs.take(inner_text(events[i : matching_end(events, i)]))
            out[i] = e.but(id=slug or None)
    return out


def hosts(events: list[Event], kind: str, allowed: Callable[[str], bool]) -> list[Event]:
    """Links that are not allowed leave their content; images leave their alt text."""
    out, i, skip = [], 0, set()
    while i < len(events):
        e = events[i]
        if e.op == "start" and e.kind == kind and not allowed(e.dest or ""):
            end = matching_end(events, i)
            if kind == "image":
                if alt := inner_text(events[i:end]):
                    out.append(Event("leaf", "text", alt, start=e.start, end=e.end))
                i = end + 1
                continue
            skip.add(end)
        elif i not in skip:
            out.append(e)
        i += 1
    return out


def img_tag(src: str, alt: str, title: str) -> str:
    name = f' title="{escape(title)}"' if title else ""
    return f'<img src="{escape_href(src)}" alt="{escape(alt)}"{name} loading="lazy" decoding="async" />'


def link_open(href: str, title: str) -> str:
    name = f' title="{escape(title)}"' if title else ""
    return f'<a href="{escape_href(href)}"{name} rel="nofollow noopener">'


def lazy_images(events: list[Event]) -> list[Event]:
    out, i = [], 0
    while i < len(events):
        e = events[i]
        if e.op == "start" and e.kind == "image":
            end = matching_end(events, i)
            out.append(Event("leaf", "inline_html", img_tag(e.dest or "", inner_text(events[i:end]), e.title or ""), start=e.start, end=e.end))
            i = end
        else:
            out.append(e)
        i += 1
    return out


def nofollow(events: list[Event]) -> list[Event]:
    out, ends = [], set()
    for i, e in enumerate(events):
        if e.op == "start" and e.kind == "link" and is_external(e.dest or ""):
            ends.add(matching_end(events, i))
            out.append(Event("leaf", "inline_html", link_open(e.dest or "", e.title or ""), start=e.start, end=e.end))
        elif i in ends:
            out.append(Event("leaf", "inline_html", "</a>"))
        else:
            out.append(e)
    return out


def highlight(events: list[Event]) -> list[Event]:
    out, i = [], 0
    while i < len(events):
        e = events[i]
        if e.op == "start" and e.kind == "code_block" and e.fenced and e.lang:
            end = matching_end(events, i)
            out.append(Event("leaf", "html", highlighted(inner_text(events[i:end]), e.lang), start=e.start, end=e.end))
            i = end
        else:
            out.append(e)
        i += 1
    return out


def before(events: list[Event], o: Options) -> list[Event]:
    """Emoji, autolink, heading ids, tag filter, raw HTML, hard wrap."""
    if o["emoji_shortcodes"]:
        events = texts(events, lambda e: [e.but(text=replace_emoji(e.text))] if ":" in e.text else [e], ("code_block", "metadata_block"))
    if o["links"]["autolink"]:
        events = texts(events, lambda e: autolinked(e) if "@" in e.text or "://" in e.text else [e], ("link", "code_block", "metadata_block"))
    if o["headings"]["ids"]:
        events = heading_ids(events)
    if not o["raw_html"]:
        events = [e.but(kind="text") if e.op == "leaf" and e.kind in ("html", "inline_html") else e for e in events]
    elif o["gfm"] and o["gfm_tag_filter"]:
        events = [e.but(text=tag_filter(e.text)) if e.op == "leaf" and e.kind in ("html", "inline_html") else e for e in events]
    if o["hard_wrap"]:
        events = [e.but(kind="hard_break") if e.kind == "soft_break" else e for e in events]
    return events


def after(events: list[Event], o: Options) -> list[Event]:
    """Highlighting, hosts, schemes, lazy images, nofollow."""
    if o["syntax_highlight"]:
        events = highlight(events)
    for kind, group in (("link", "links"), ("image", "images")):
        if (globs := o[group]["allowed_hosts"]) is not None:
            host_pattern(tuple(globs))
            events = hosts(events, kind, lambda u, globs=tuple(globs): host_allowed(u, globs))
    for kind, group in (("link", "links"), ("image", "images")):
        if (schemes := o[group]["allowed_schemes"]) is not None:
            events = hosts(events, kind, lambda u, schemes=tuple(s.lower() for s in schemes): scheme_allowed(u, schemes))
    if o["images"]["lazy"]:
        events = lazy_images(events)
    if o["links"]["nofollow"]:
        events = nofollow(events)
    return events


def apply(events: list[Event], o: Options) -> list[Event]:
    return after(before(events, o), o)


def content(events: list[Event]) -> list[Event]:
    """The events without metadata blocks."""
    out, inside = [], False
    for e in events:
        if e.kind == "metadata_block":
            inside = e.op == "start"
        elif not inside:
            out.append(e)
    return out
