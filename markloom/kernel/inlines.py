"""Inline structure: one pass over a leaf block's text, then delimiters are paired."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from .events import Event
from .syntax import Syntax

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])|&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{0,31});")
ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{0,31}));")
LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)
ANGLED = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")
TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S)
GAP = re.compile(r"[ \t]*\n?[ \t]*")
ATTRIBUTE = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\"'=<>`\s]+|'[^']*'|\"[^\"]*\"))?)"
TAG = re.compile(rf"<[A-Za-z][A-Za-z0-9-]*{ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
TICKS = re.compile(r"`+")


def decoded(m: re.Match) -> str | None:
    """The characters of an entity, or None if there is no such entity."""
    if m[1] or m[2]:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return html.entities.html5.get(f"{m[3]};")


def unescape(text: str) -> str:
    """Backslash escapes and entities resolved."""
    if "\\" not in text and "&" not in text:
        return text
    return ESCAPED.sub(lambda m: m[1] or (decoded(ENTITY.match(m[0])) if ENTITY.match(m[0]) else None) or m[0], text)


def normal_label(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold()


def destination(text: str, at: int) -> tuple[int, str] | None:
    """End and value of a link destination."""
    if text[at : at + 1] == "<":
        m = ANGLED.match(text, at)
        return (m.end(), unescape(m[1])) if m else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] in PUNCTUATION and i + 1 < len(text):
            i += 2
            continue
        if c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c <= " " or c == "\x7f":
            break
        i += 1
    return (i, unescape(text[at:i])) if not depth else None


def title(text: str, at: int) -> tuple[int, str] | None:
    m = TITLE.match(text, at)
    if not m:
        return None
    value = next(x for x in m.groups() if x is not None)
    return None if re.search(r"\n[ \t]*\n", value) else (m.end(), unescape(value))


def reference(text: str, at: int = 0) -> tuple[int, str, str, str] | None:
    """A link reference definition at a place: where it ends, its label, destination, title."""
    m = LABEL.match(text, at)
    if not m or not m[1].strip() or text[m.end() : m.end() + 1] != ":" or m[1].startswith("^"):
        return None
    at = GAP.match(text, m.end() + 1).end()
    found = destination(text, at)
    if not found or found[0] == at:
        return None
    end, dest = found
    gap = GAP.match(text, end).end()
    named = title(text, gap) if gap > end else None
    if named:
        rest = re.compile(r"[ \t]*(?:\n|$)").match(text, named[0])
        if rest:
            return rest.end(), normal_label(m[1]), dest, named[1]
    rest = re.compile(r"[ \t]*(?:\n|$)").match(text, end)
    return (rest.end(), normal_label(m[1]), dest, "") if rest else None


@lru_cache(maxsize=4096)
def character_class(c: str) -> int:
    """0 white space or an edge, 1 punctuation or symbol, 2 other."""
    if not c or c.isspace():
        return 0
    return 1 if unicodedata.category(c)[0] in "PS" else 2


class Node:
    __slots__ = ("active", "can_close", "can_open", "char", "count", "event", "image", "next", "prev", "size")

    def __init__(self, event: Event | None):
        self.event, self.prev, self.next = event, None, None
        self.char, self.count, self.size, self.can_open, self.can_close = "", 0, 0, False, False
        self.active, self.image = True, False


@lru_cache(maxsize=64)
def special_of(syntax: Syntax) -> re.Pattern:
    extra = ("~" if syntax.strikethrough or syntax.subscript else "") + ("^" if syntax.superscript else "") + ("$" if syntax.math else "") + ("\"'.-" if syntax.smart_punctuation else "")
    return re.compile(rf"[\\`*_\[\]!<&\n{re.escape(extra)}]")


@lru_cache(maxsize=64)
def marked_of(syntax: Syntax) -> re.Pattern:
    """special_of() without the line end."""
    return re.compile(special_of(syntax).pattern.replace(r"\n", "", 1))


class Inlines:
    """The inline events of one leaf block. Offsets are places in the joined text."""

    def __init__(self, text: str, syntax: Syntax, references: dict[str, tuple[str, str]], footnotes: set[str]):
        self.text, self.syntax, self.references, self.footnotes = text, syntax, references, footnotes
        self.head = self.tail = Node(None)
        self.delimiters: list[Node] = []
        self.brackets: list[tuple[Node, int, int]] = []  # node, place after it, delimiters before it

    def put(self, event: Event | None) -> Node:
        node = Node(event)
        node.prev = self.tail
        self.tail.next = node
        self.tail = node
        return node

    def say(self, text: str, start: int, end: int) -> None:
        if text:
            self.put(Event("leaf", "text", text, start=start, end=end))

    @staticmethod
    def after(node: Node, new: Node, inline: Inlines) -> None:
        new.prev, new.next = node, node.next
        if node.next:
            node.next.prev = new
        else:
            inline.tail = new
        node.next = new

    def events(self) -> list[Event]:
        text, special = self.text, special_of(self.syntax)
        at, start, n = 0, 0, len(self.text)
        while m := special.search(text, at):
            i = m.start()
            used = self.one(text[i], i, start)
            if used is None or used < 0:  # ordinary characters after all, up to ~used
                at = i + 1 if used is None else ~used
                continue
            at = start = used
        self.say(text[start:n], start, n)
        self.pair(0)
        out, node = [], self.head.next
        while node:
            if node.event:
                out.append(node.event)
            elif node.count:
                first = (node.size - node.count) if node.can_close and not node.can_open else 0
                out += [Event("leaf", "text", node.char, start=node.active + k + first, end=node.active + k + first + 1) for k in range(node.count)]
            node = node.next
        return out

    def one(self, c: str, i: int, start: int) -> int | None:
        """Handles the special character at i; text from start on is pending. Gives the next place;
        None or ~place if nothing special is there."""
        text = self.text
        if c == "\n":
            before = text[start:i]
            body = before.rstrip(" ")
            hard = len(before) - len(body) >= 2
            self.say(body.rstrip(" \t"), start, start + len(body))
            self.put(Event("leaf", "hard_break" if hard else "soft_break", start=i, end=i + 1))
            return i + 1
        if c == "\\":
            follow = text[i + 1 : i + 2]
            if follow == "\n":
                self.say(text[start:i], start, i)
                self.put(Event("leaf", "hard_break", start=i, end=i + 2))
                return i + 2
            if follow and follow in PUNCTUATION:
                self.say(text[start:i], start, i)
                # the escaped character begins the next text
                nxt = special_of(self.syntax).search(text, i + 2)
                end = nxt.start() if nxt else len(text)
                if nxt and nxt[0] == "\n":
                    self.say(text[i + 1 : end].rstrip(" \t") if len(text[i + 2 : end].strip(" \t")) or text[i + 2 : end] else text[i + 1 : end], i + 1, end)
                    hard = len(text[i + 2 : end]) - len(text[i + 2 : end].rstrip(" ")) >= 2
                    self.put(Event("leaf", "hard_break" if hard else "soft_break", start=end, end=end + 1))
                    return end + 1
                self.say(text[i + 1 : end], i + 1, end)
                return end
            return None
        if c == "`":
            run = TICKS.match(text, i)[0]
            for m in TICKS.finditer(text, i + len(run)):
                if m[0] == run:
                    body = text[i + len(run) : m.start()].replace("\n", " ")
                    if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
                        body = body[1:-1]
                    self.say(text[start:i], start, i)
                    self.put(Event("leaf", "code", body, start=i, end=m.end()))
                    return m.end()
            self.say(text[start:i], start, i)
            self.say(run, i, i + len(run))
            return i + len(run)
        if c == "&":
            m = ENTITY.match(text, i)
            value = decoded(m) if m else None
            if value is None:
                return None
            self.say(text[start:i], start, i)
            self.say(value, i, m.end())
            return m.end()
        if c == "<":
            self.say(text[start:i], start, i)
            if m := URI.match(text, i):
                self.link(m[1], m[1], "autolink", i, m.end())
            elif m := MAIL.match(text, i):
                self.link(m[1], m[1], "email", i, m.end())
            elif m := TAG.match(text, i):
                self.put(Event("leaf", "inline_html", m[0], start=i, end=m.end()))
            else:
                self.say("<", i, i + 1)
                return i + 1
            return m.end()
        if c == "$" and self.syntax.math:
            return self.formula(i, start)
        if c in "*_" or c == "~" or c == "^":
            return self.run(c, i, start)
        if c in "\"'.-":
            return self.smart(c, i, start)
        if c == "!":
            if text[i + 1 : i + 2] != "[":
                return None
            self.say(text[start:i], start, i)
            return self.bracket(i, 2)
        if c == "[":
            self.say(text[start:i], start, i)
            if self.syntax.wikilinks and (m := re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]").match(text, i)):
                self.link(m[1].strip(), m[2] if m[2] is not None else m[1], "wikilink", i, m.end())
                return m.end()
            if self.syntax.footnotes and (m := re.compile(r"\[\^([^\]\s\[]+)\]").match(text, i)) and normal_label(m[1]) in self.footnotes:
                self.put(Event("leaf", "footnote_reference", m[1], label=m[1], start=i, end=m.end()))
                return m.end()
            return self.bracket(i, 1)
        if c == "]":
            self.say(text[start:i], start, i)
            return self.close_bracket(i)
        return None

    def link(self, dest: str, text: str, kind: str, start: int, end: int) -> None:
        self.put(Event("start", "link", dest=dest, title="", link_type=kind, start=start, end=end))
        self.say(text, start + 1, end - 1)
        self.put(Event("end", "link", start=start, end=end))

    def formula(self, i: int, start: int) -> int | None:
        text = self.text
        wide = text[i : i + 2] == "$$"
        m = re.compile(r"\$\$(.+?)\$\$" if wide else r"\$(?=[^\s$])((?:[^$\\]|\\.)*?[^\s\\])\$(?!\d)", re.S).match(text, i)
        if not m:
            return None
        self.say(text[start:i], start, i)
        self.put(Event("leaf", "display_math" if wide else "inline_math", m[1], start=i, end=m.end()))
        return m.end()

    def smart(self, c: str, i: int, start: int) -> int | None:
        text = self.text
        if c == ".":
            if not text.startswith("...", i):
                return None
            self.say(text[start:i], start, i)
            self.say("\u2026", i, i + 3)
            return i + 3
        if c == "-":
            n = len(re.compile("-+").match(text, i)[0])
            if n < 2:
                return None
            em, en = (n // 3, 0) if n % 3 == 0 else (0, n // 2) if n % 2 == 0 else ((n - 2) // 3, 1) if n % 3 == 2 else ((n - 4) // 3, 2)
            self.say(text[start:i], start, i)
            self.say("\u2014" * em + "\u2013" * en, i, i + n)
            return i + n
        self.say(text[start:i], start, i)
        node = self.delimiter(c, i, 1)
        return i + 1 if node else i + 1

    def run(self, c: str, i: int, start: int) -> int | None:
        text = self.text
        n = 1
        while text[i + n : i + n + 1] == c:
            n += 1
        if c in "~^" and (n > 2 or c == "^" and n > 1):
            return ~(i + n)
        before, after = character_class(text[i - 1 : i] if i else ""), character_class(text[i + n : i + n + 1])
        left = after != 0 and (after != 1 or before != 2)
        right = before != 0 and (before != 1 or after != 2)
        if not (left or right) or c == "_" and left and right and before == 2 and after == 2:
            return ~(i + n)
        self.say(text[start:i], start, i)
        self.delimiter(c, i, n)
        return i + n

    def delimiter(self, c: str, i: int, n: int) -> Node:
        text = self.text
        before, after = character_class(text[i - 1 : i] if i else ""), character_class(text[i + n : i + n + 1])
        left = after != 0 and (after != 1 or before != 2)
        right = before != 0 and (before != 1 or after != 2)
        node = self.put(None)
        node.char, node.count, node.size, node.active = c, n, n, i
        if c == "_":
            node.can_open, node.can_close = left and (not right or before == 1), right and (not left or after == 1)
        elif c in "\"'":
            node.can_open, node.can_close = left and not right, right
        else:
            node.can_open, node.can_close = left, right
        self.delimiters.append(node)
        return node

    def bracket(self, i: int, n: int) -> int:
        node = self.put(Event("leaf", "text", self.text[i : i + n], start=i, end=i + n))
        node.image = n == 2
        self.brackets.append((node, i + n, len(self.delimiters)))
        return i + n

    def close_bracket(self, i: int) -> int:
        text = self.text
        if not self.brackets:
            self.say("]", i, i + 1)
            return i + 1
        node, inner, below = self.brackets.pop()
        if not node.active:
            self.say("]", i, i + 1)
            return i + 1
        found = self.target(i, inner)
        if not found:
            self.say("]", i, i + 1)
            return i + 1
        end, dest, name, kind, ref = found
        start = node.event.start
        node.event = Event("start", "image" if node.image else "link", dest=dest, title=name, link_type=kind, ref_id=ref, start=start, end=end)
        self.pair(below)
        self.put(Event("end", node.event.kind, start=start, end=end))
        if not node.image:
            for other, _, _ in self.brackets:
                if not other.image:
                    other.active = False
        return end

    def target(self, i: int, inner: int) -> tuple[int, str, str, str, str] | None:
        """What follows the closing bracket at i: end, destination, title, type, reference."""
        text = self.text
        if text[i + 1 : i + 2] == "(":
            at = GAP.match(text, i + 2).end()
            found = destination(text, at)
            if found:
                end, dest = found
                gap = GAP.match(text, end).end()
                named = title(text, gap) if gap > end else None
                if named:
                    gap = GAP.match(text, named[0]).end()
                if text[gap : gap + 1] == ")":
                    return gap + 1, dest, named[1] if named else "", "inline", ""
        m = LABEL.match(text, i + 1)
        if m and m[1].strip():
            hit = self.references.get(normal_label(m[1]))
            return (m.end(), *hit, "reference", m[1]) if hit else None
        label = LABEL.match(text, inner - 1)
        if not label or label.end() != i + 1 or not label[1].strip():
            return None
        hit = self.references.get(normal_label(label[1]))
        if not hit:
            return None
        if text.startswith("[]", i + 1):
            return i + 3, *hit, "collapsed", label[1]
        return i + 1, *hit, "shortcut", label[1]

    def pair(self, below: int) -> None:
        """Pairs the delimiters above `below` and drops them from the stack."""
        stack = self.delimiters
        bottom: dict[tuple, int] = {}
        k = below
        while k < len(stack):
            closer = stack[k]
            if not closer.can_close or not closer.count:
                k += 1
                continue
            key = (closer.char, closer.can_open, closer.size % 3 if closer.char in "*_" else closer.size)
            j = k - 1
            least = bottom.get(key, below)
            while j >= least:
                opener = stack[j]
                if opener.char == closer.char and opener.can_open and opener.count and self.fits(opener, closer):
                    break
                j -= 1
            if j < least:
                bottom[key] = k
                if closer.char == "'":
                    closer.event = Event("leaf", "text", "\u2019", start=closer.active, end=closer.active + 1)
                elif closer.char == '"':
                    closer.event = Event("leaf", "text", "\u201d", start=closer.active, end=closer.active + 1)
                if not closer.can_open:
                    del stack[k]
                else:
                    k += 1
                continue
            del stack[j + 1 : k]
            k = j + 1
            self.join(stack[j], closer)
            if not stack[j].count:
                del stack[j]
                k -= 1
            if not closer.count:
                del stack[k]
        for node in stack[below:]:
            if node.char in "\"'" and node.char and not node.event:
                opens = node.char == '"' and node.can_open
                node.event = Event("leaf", "text", "\u201c" if opens else "\u2019" if node.char == "'" else "\u201d", start=node.active, end=node.active + 1)
        del stack[below:]

    @staticmethod
    def fits(opener: Node, closer: Node) -> bool:
        if opener.char in "~^":
            return opener.count == closer.count
        if opener.char in "\"'":
            return opener.event is None
        return not ((opener.can_close or closer.can_open) and closer.size % 3 and (opener.size + closer.size) % 3 == 0)

    def join(self, opener: Node, closer: Node) -> None:
        c = opener.char
        if c in "\"'":
            opener.event = Event("leaf", "text", "\u201c" if c == '"' else "\u2018", start=opener.active, end=opener.active + 1)
            closer.event = Event("leaf", "text", "\u201d" if c == '"' else "\u2019", start=closer.active, end=closer.active + 1)
            opener.count = closer.count = 0
            return
        use = opener.count if c in "~^" else 2 if opener.count >= 2 and closer.count >= 2 else 1
        kind = "superscript" if c == "^" else ("subscript" if use == 1 and self.syntax.subscript else "strikethrough") if c == "~" else "strong" if use == 2 else "emphasis"
        opener.count -= use
        closer.count -= use
        start, end = opener.active + opener.count, closer.active + closer.size - closer.count
        first, last = Node(Event("start", kind, start=start, end=end)), Node(Event("end", kind, start=start, end=end))
        self.after(opener, first, self)
        self.after(closer.prev, last, self)


def located(events: list[Event], lines: list[tuple[int, str]]) -> list[Event]:
    """Moves the events' offsets from the joined text of `lines` to the source."""
    ends, at = [], 0
    for _, x in lines:
        ends.append(at)
        at += len(x) + 1
    moved = lambda p: lines[k := max(0, bisect_right(ends, p) - 1)][0] + p - ends[k]
    for e in events:
        e.start, e.end = moved(e.start), moved(e.end - 1) + 1 if e.end > 0 else moved(0)
    return events
