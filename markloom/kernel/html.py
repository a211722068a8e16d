"""The HTML sink."""

from __future__ import annotations

import re

from .events import Event, matching_end

SAFE = re.compile(r"[^A-Za-z0-9!#$%()*+,\-./:;=?@_~]")


def escape(text: str) -> str:
    """For attribute values."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_text(text: str) -> str:
    """For text nodes: quotes stay."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if "&" in text or "<" in text or ">" in text else text


def escape_href(url: str) -> str:
    return SAFE.sub(lambda m: {"&": "&amp;", "'": "&#x27;"}.get(m[0]) or "".join(f"%{b:02X}" for b in m[0].encode()), url)


ENDS = {
    "paragraph": "</p>\n", "blockquote": "</blockquote>\n", "code_block": "</code></pre>\n", "list": "</ul>\n", "ordered_list": "</ol>\n",
    "list_item": "</li>\n", "footnote_definition": "</div>\n", "table": "</tbody></table>\n", "table_head": "</tr></thead><tbody>\n",
    "table_row": "</tr>\n", "emphasis": "</em>", "strong": "</strong>", "strikethrough": "</del>", "link": "</a>", "definition_list": "</dl>\n",
    "definition_list_title": "</dt>\n", "definition_list_definition": "</dd>\n", "superscript": "</sup>", "subscript": "</sub>", "html_block": "",
}
PLAIN_STARTS = {"emphasis": "<em>", "strong": "<strong>", "strikethrough": "<del>", "superscript": "<sup>", "subscript": "<sub>", "table": "<table>", "table_row": "<tr>", "table_head": "<thead><tr>", "html_block": ""}
LINE_STARTS = {"paragraph": "<p>", "list": "<ul>\n", "list_item": "<li>", "definition_list": "<dl>\n", "definition_list_title": "<dt>", "definition_list_definition": "<dd>"}


class Writer:
    """Writes events; block tags begin on a line of their own."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.fresh = True
        self.numbers: dict[str, int] = {}
        self.head = False

    def write(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.fresh = text[-1] == "\n"

    def block(self, text: str) -> None:
        self.write(text if self.fresh else "\n" + text)

    def number(self, label: str) -> int:
        return self.numbers.setdefault(label, len(self.numbers) + 1)

    def run(self, events: list[Event]) -> str:
        i, n = 0, len(events)
        while i < n:
            e = events[i]
            if e.op == "start" and e.kind == "image":
                j = matching_end(events, i)
                alt = "".join(self.alt(x) for x in events[i + 1 : j])
                name = f' title="{escape(e.title)}"' if e.title else ""
                self.write(f'<img src="{escape_href(e.dest or "")}" alt="{alt}"{name} />')
                i = j + 1
                continue
            if e.op == "start" and e.kind == "metadata_block":
                i = matching_end(events, i) + 1
                continue
            if e.op == "leaf":
                self.leaf(e)
            elif e.op == "start":
                self.start(e)
            elif e.kind == "heading":
                self.write(f"</h{e.level}>\n")
            elif e.kind == "table_cell":
                self.write("</th>" if self.head else "</td>")
            else:
                if e.kind == "table_head":
                    self.head = False
                self.write(ENDS[e.kind])
            i += 1
        return "".join(self.out)

    def alt(self, e: Event) -> str:
        if e.op != "leaf":
            return ""
        if e.kind in ("text", "code", "inline_html"):
            return escape(e.text)
        if e.kind in ("soft_break", "hard_break", "rule"):
            return " "
        if e.kind == "footnote_reference":
            return f"[{self.number(e.label or '')}]"
        if e.kind in ("inline_math", "display_math"):
            mark = "$" if e.kind == "inline_math" else "$$"
            return mark + escape(e.text) + mark
        return ""

    def leaf(self, e: Event) -> None:
        kind = e.kind
        if kind == "text":
            self.write(escape_text(e.text))
        elif kind == "code":
            self.write(f"<code>{escape_text(e.text)}</code>")
        elif kind in ("html", "inline_html"):
            self.write(e.text)
        elif kind == "soft_break":
            self.write("\n")
        elif kind == "hard_break":
            self.write("<br />\n")
        elif kind == "rule":
            self.block("<hr />\n")
        elif kind == "footnote_reference":
            self.write(f'<sup class="footnote-reference"><a href="#{escape(e.label)}">{self.number(e.label)}</a></sup>')
        elif kind == "task_list_marker":
            self.write('<input disabled="" type="checkbox"' + (' checked=""' if e.checked else "") + "/>\n")
        else:
            self.write(f'<span class="math math-{"inline" if kind == "inline_math" else "display"}">{escape(e.text)}</span>')

    def start(self, e: Event) -> None:
        kind = e.kind
        if kind in PLAIN_STARTS:
            self.head = self.head or kind == "table_head"
            self.write(PLAIN_STARTS[kind])
        elif kind in LINE_STARTS:
            self.block(LINE_STARTS[kind])
        elif kind == "heading":
            parts = [f"<h{e.level}"]
            if e.id is not None:
                parts.append(f' id="{escape(e.id)}"')
            if e.classes:
                parts.append(f' class="{" ".join(map(escape, e.classes))}"')
            parts += [f' {escape(k)}="{escape(v or "")}"' for k, v in e.attrs]
            self.block("".join(parts) + ">")
        elif kind == "link":
            name = f'" title="{escape(e.title)}' if e.title else ""
            self.write(f'<a href="{"mailto:" if e.link_type == "email" else ""}{escape_href(e.dest or "")}{name}">')
        elif kind == "code_block":
            lang = (e.lang or "").split(" ")[0]
            self.block(f'<pre><code class="language-{escape(lang)}">' if lang else "<pre><code>")
        elif kind == "blockquote":
            self.block(f'<blockquote class="markdown-alert-{e.alert}">\n' if e.alert else "<blockquote>\n")
        elif kind == "ordered_list":
            self.block("<ol>\n" if e.list_start in (1, None) else f'<ol start="{e.list_start}">\n')
        elif kind == "table_cell":
            align = (e.align or ["none"])[0]
            style = "" if align == "none" else f' style="text-align: {align}"'
            self.write(f"<{'th' if self.head else 'td'}{style}>")
        elif kind == "footnote_definition":
            self.block(f'<div class="footnote-definition" id="{escape(e.label)}"><sup class="footnote-definition-label">{self.number(e.label)}</sup>')


def to_html(events: list[Event]) -> str:
    return Writer().run(events)
