"""Block structure: CommonMark and its extensions, line by line.

Containers that are open are kept on a stack; each line first continues them, then opens new ones,
then adds what remains to the deepest. The result is a tree of blocks, whose leaves hold their
lines with source offsets for the inline pass.
"""

from __future__ import annotations

import re

from .inlines import normal_label, reference, unescape
from .syntax import Syntax

RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
LINE = re.compile(r"([^\n\r]*)(\r\n|\n|\r|$)")
ATX_CLOSE = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
FENCE = re.compile(r"(`{3,})(?=[^`]*$)|(~{3,})")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
BULLET = re.compile(r"[*+-]")
NUMBER = re.compile(r"(\d{1,9})([.)])")
TABLE_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
FOOTNOTE = re.compile(r"\[\^([^\]\s\[]+)\]:[ \t]*")
ALERT = re.compile(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*$", re.IGNORECASE)

#: The tag names that begin an HTML block of the sixth kind (CommonMark 0.31.2).
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
TAG_NAME = r"[A-Za-z][A-Za-z0-9-]*"
ATTRIBUTE = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\"'=<>`\s]+|'[^']*'|\"[^\"]*\"))?)"
HTML_OPEN = [
    re.compile(r"<(?:script|pre|textarea|style)(?:\s|>|$)", re.I),
    re.compile(r"<!--"),
    re.compile(r"<\?"),
    re.compile(r"<![A-Za-z]"),
    re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS)})(?:\s|/?>|$)", re.I),
    re.compile(rf"(?:<{TAG_NAME}{ATTRIBUTE}*\s*/?>|</{TAG_NAME}\s*>)\s*$", re.I),
]
HTML_CLOSE = [re.compile(r"</(?:script|pre|textarea|style)>", re.I), re.compile(r"-->"), re.compile(r"\?>"), re.compile(r">"), re.compile(r"\]\]>")]


class Block:
    __slots__ = ("alert", "align", "attrs", "blank", "children", "classes", "data", "end", "fenced", "id", "kind", "level", "lines", "loose", "open", "parent", "start")

    def __init__(self, kind: str, start: int, parent: Block | None = None):
        self.kind, self.start, self.end, self.parent = kind, start, start, parent
        self.children: list[Block] = []
        self.lines: list[tuple[int, str]] = []  # source offset, text
        self.open, self.blank, self.loose, self.level, self.fenced = True, False, False, 0, False
        self.data: dict = {}
        self.id, self.classes, self.attrs, self.align, self.alert = None, [], [], None, None


#: Kinds that take lines; kinds that hold no blocks.
TAKES_LINES = {"paragraph", "code_block", "html_block", "table"}
LEAF_KINDS = {*TAKES_LINES, "heading", "rule", "metadata_block", "definition_list_title"}
#: What a line does to a block: it goes on, does not, or is used up.
GOES_ON, ENDS, USED = range(3)


class Blocks:
    """Parses one source into a tree of blocks, with its link references and footnote labels."""

    def __init__(self, source: str, syntax: Syntax):
        self.source, self.syntax = source, syntax
        self.root = self.tip = Block("document", 0)
        self.references: dict[str, tuple[str, str]] = {}
        self.footnotes: set[str] = set()
        pos, n = 0, len(source)
        if syntax.frontmatter and re.match(r"---[ \t]*(?:\r?\n)", source):
            pos = self.metadata(source.index("\n") + 1)
        for m in LINE.finditer(source, pos):
            if m.start() == n and m.end() == n:
                break
            self.line, self.line_start, self.next_line = m[1].replace("\0", "\ufffd"), m.start(), m.end()
            if not (self.line[:1].isalpha() and self.prose()):
                self.eat_line()
        self.line_start = self.next_line = n
        while self.tip is not self.root:
            self.close(self.tip)
        self.root.end = n

    def prose(self) -> bool:
        """A line that begins with a letter begins no block but a paragraph: at the top level it goes
        on with the open one, or begins one if nothing is open."""
        tip, root = self.tip, self.root
        if tip is root:
            root.children.append(tip := Block("paragraph", self.line_start, root))
            self.tip = tip
        elif tip.kind != "paragraph" or tip.parent is not root:
            return False
        tip.lines.append((self.line_start, self.line))
        tip.end, tip.blank = self.next_line, False
        return True

    def metadata(self, pos: int) -> int:
        """A YAML block at the top. None if it never closes or begins with a blank line."""
        m = re.compile(r"(?m)^(?:---|\.\.\.)[ \t]*\r?$").search(self.source, pos)
        if not m or m.start() > pos and not self.source[pos:].split("\n", 1)[0].strip():
            return 0
        block = Block("metadata_block", 0, self.root)
        block.lines, block.end, block.open = [(pos, self.source[pos : m.start()])], m.end(), False
        self.root.children.append(block)
        return min(len(self.source), m.end() + 1)

    # -- the cursor

    def find_nonspace(self) -> None:
        i, column, line = self.offset, self.column, self.line
        if i < len(line) and line[i] not in " \t":
            self.nonspace, self.nonspace_column, self.blank, self.indent = i, column, False, 0
            return
        while i < len(line):
            if line[i] == " ":
                column += 1
            elif line[i] == "\t":
                column += 4 - column % 4
            else:
                break
            i += 1
        self.nonspace, self.nonspace_column = i, column
        self.blank, self.indent = i >= len(line), column - self.column

    def advance(self, count: int, columns: bool = False) -> None:
        line = self.line
        while count > 0 and self.offset < len(line):
            if line[self.offset] == "\t":
                to_tab = 4 - self.column % 4
                self.partial = columns and to_tab > count
                self.column += min(count, to_tab) if columns else to_tab
                self.offset += not self.partial
                count -= min(count, to_tab) if columns else 1
            else:
                self.partial = False
                self.offset += 1
                self.column += 1
                count -= 1

    def at_space(self) -> bool:
        return self.line[self.offset : self.offset + 1] in (" ", "\t")

    def to_nonspace(self) -> None:
        self.offset, self.column, self.partial = self.nonspace, self.nonspace_column, False

    def to_end(self) -> None:
        self.offset = len(self.line)

    def add_line(self) -> None:
        tip = self.tip
        if tip.kind in ("paragraph", "table"):
            self.find_nonspace()
            self.to_nonspace()
        at, text = self.line_start + self.offset, self.line[self.offset :]
        if self.partial:
            at, text = at + 1, " " * (4 - self.column % 4) + text[1:]
        tip.lines.append((at, text))
        self.stretch(tip)

    def stretch(self, block: Block | None) -> None:
        # what is around a block that reaches so far does too
        while block and block.end < self.next_line:
            block.end = self.next_line
            block = block.parent

    # -- the tree

    def add(self, kind: str, start: int) -> Block:
        while not self.can_contain(self.tip, kind):
            self.close(self.tip)
        self.tip.children.append(block := Block(kind, start, self.tip))
        self.tip = block
        self.stretch(block)
        return block

    @staticmethod
    def can_contain(parent: Block, kind: str) -> bool:
        if parent.kind in ("list", "ordered_list"):
            return kind == "list_item"
        if parent.kind == "definition_list":
            return kind == "definition_list_definition"
        return parent.kind not in LEAF_KINDS and kind not in ("list_item", "definition_list_definition")

    def close_unmatched(self) -> None:
        if not self.all_closed:
            while self.old_tip is not self.last_matched:
                parent = self.old_tip.parent
                self.close(self.old_tip)
                self.old_tip = parent
            self.all_closed = True

    def close(self, block: Block) -> None:
        block.open = False
        if block.kind == "paragraph":
            self.take_references(block)
            if not block.lines:
                block.parent.children.remove(block)
        elif block.kind == "code_block" and not block.fenced:
            while block.lines and not block.lines[-1][1].strip(" \t"):
                block.lines.pop()
            if block.lines:
                block.end = block.lines[-1][0] + len(block.lines[-1][1])
        elif block.kind in ("list", "ordered_list"):
            block.loose = any(
                self.ends_blank(item) and i + 1 < len(block.children) or any(self.ends_blank(child) and (i + 1 < len(block.children) or j + 1 < len(item.children)) for j, child in enumerate(item.children))
                for i, item in enumerate(block.children)
            )
        self.tip = block.parent

    @staticmethod
    def ends_blank(block: Block | None) -> bool:
        while block:
            if block.blank:
                return True
            block = block.children[-1] if block.kind in ("list", "ordered_list", "list_item") and block.children else None
        return False

    def take_references(self, block: Block) -> None:
        """Link reference definitions at the head of a paragraph leave it."""
        lines = block.lines
        if not lines or not lines[0][1].startswith("["):
            return
        text = "\n".join(x for _, x in lines)
        at = taken = 0
        while taken < len(lines) and lines[taken][1].startswith("[") and (found := reference(text, at)):
            end, label, dest, title = found
            self.references.setdefault(label, (dest, title))
            taken = taken + text.count("\n", at, end) if end < len(text) else len(lines)
            at = end
        if taken:
            block.lines = lines[taken:]
            if block.lines:
                block.start = block.lines[0][0]

    # -- one line

    def eat_line(self) -> None:
        self.offset = self.column = 0
        self.partial = False
        container, self.old_tip = self.root, self.tip
        while container.children and container.children[-1].open:
            child = container.children[-1]
            self.find_nonspace()
            verdict = self.continues(child)
            if verdict == USED:
                return
            if verdict == ENDS:
                break
            container = child
        self.all_closed, self.last_matched = container is self.old_tip, container
        self.find_nonspace()
        leaf = container.kind != "paragraph" and container.kind in TAKES_LINES
        while not leaf:
            self.find_nonspace()
            opened = self.opens(container)
            if opened is None:
                self.to_nonspace()
                break
            container, leaf = self.tip, opened.kind in LEAF_KINDS or self.offset >= len(self.line)
            if opened.kind not in LEAF_KINDS and not opened.alert:
                self.find_nonspace()
        if not self.all_closed and not self.blank and self.tip.kind == "paragraph":
            self.add_line()  # lazy continuation
            return
        self.close_unmatched()
        if self.blank and container.children:
            container.children[-1].blank = True
        fresh = container.start >= self.line_start
        blank = self.blank and container.kind not in LEAF_KINDS - {"paragraph"} and container.kind != "blockquote" and not (container.kind in ("list_item", "footnote_definition", "definition_list_definition") and not container.children and fresh)
        if container.kind == "code_block":
            blank = self.blank and not container.fenced
        up: Block | None = container
        while up:
            up.blank, up = blank, up.parent
        if container.kind in TAKES_LINES and container.open:
            if not (container.kind == "code_block" and container.fenced and fresh) and not (container.kind == "table" and container.data.pop("begun", False)):
                self.add_line()
            if container.kind == "html_block" and container.level <= 5 and HTML_CLOSE[container.level - 1].search(self.line[self.offset :]):
                self.close(container)
        elif self.offset < len(self.line) and not self.blank and container.kind not in LEAF_KINDS:
            self.add("paragraph", self.line_start + self.nonspace)
            self.add_line()

    def continues(self, block: Block) -> int:
        kind = block.kind
        if kind == "blockquote":
            if self.indent <= 3 and self.line[self.nonspace : self.nonspace + 1] == ">":
                self.to_nonspace()
                self.advance(1)
                if self.at_space():
                    self.advance(1, True)
                return GOES_ON
            return ENDS
        if kind in ("list", "ordered_list", "definition_list"):
            return GOES_ON
        if kind in ("list_item", "definition_list_definition", "footnote_definition"):
            if self.blank:
                if not block.children and kind != "footnote_definition":
                    return ENDS
                self.to_nonspace()
                return GOES_ON
            if self.indent >= block.data["width"]:
                self.advance(block.data["width"], True)
                return GOES_ON
            return ENDS
        if kind == "code_block":
            if block.fenced:
                m = re.match(r"(`+|~+)[ \t]*$", self.line[self.nonspace :]) if self.indent <= 3 else None
                if m and m[1][0] == block.data["char"] and len(m[1]) >= block.data["length"]:
                    self.stretch(block.parent)
                    block.end = self.line_start + len(self.line)
                    while self.tip is not block:
                        self.close(self.tip)
                    self.close(block)
                    return USED
                skip = block.data["indent"]
                while skip and self.at_space():
                    self.advance(1, True)
                    skip -= 1
                return GOES_ON
            if self.indent >= 4:
                self.advance(4, True)
                return GOES_ON
            if self.blank:
                self.to_nonspace()
                return GOES_ON
            return ENDS
        if kind == "html_block":
            return ENDS if self.blank and block.level >= 6 else GOES_ON
        if kind == "paragraph":
            return ENDS if self.blank else GOES_ON
        if kind == "table":
            rest = self.line[self.nonspace :]
            other = self.blank or self.indent >= 4 or rest[0] == ">" or ATX.match(rest) or FENCE.match(rest) or RULE.match(rest) or self.marker(False) or any(p.match(rest) for p in HTML_OPEN[:6])
            return ENDS if other else GOES_ON
        return ENDS

    def marker(self, in_paragraph: bool) -> dict | None:
        """A list marker at the cursor, or None."""
        rest = self.line[self.nonspace :]
        if m := BULLET.match(rest):
            data = {"kind": "list", "char": m[0], "start": None}
        elif (m := NUMBER.match(rest)) and not (in_paragraph and int(m[1]) != 1):
            data = {"kind": "ordered_list", "char": m[2], "start": int(m[1])}
        else:
            return None
        after = rest[m.end() :]
        if after and after[0] not in " \t" or in_paragraph and not after.strip(" \t"):
            return None
        return data | {"length": m.end()}

    def opens(self, container: Block) -> Block | None:
        """A new block at the cursor, or None."""
        if self.blank:
            return None
        rest, at, syntax = self.line[self.nonspace :], self.line_start + self.nonspace, self.syntax
        if self.indent >= 4:
            if self.tip.kind == "paragraph":
                return None
            self.advance(4, True)
            self.close_unmatched()
            return self.add("code_block", self.line_start + self.offset)
        c = rest[0]
        if c == ">":
            self.to_nonspace()
            self.advance(1)
            if self.at_space():
                self.advance(1, True)
            self.close_unmatched()
            block = self.add("blockquote", at)
            if syntax.gfm and (m := ALERT.match(self.line[self.offset :].lstrip(" \t"))):
                block.alert = m[1].lower()
                self.to_end()
            return block
        if c == "#" and (m := ATX.match(rest)):
            self.close_unmatched()
            block = self.add("heading", at)
            block.level = len(m[1])
            text = self.heading_attributes(block, ATX_CLOSE.sub("", rest[m.end() :]).rstrip(" \t"))
            text = ATX_CLOSE.sub("", text).rstrip(" \t") if block.id or block.classes or block.attrs else text
            block.lines = [(at + m.end() + len(text) - len(text.lstrip(" \t")), text.lstrip(" \t"))]
            return self.finished(block)
        if c in "`~" and (m := FENCE.match(rest)):
            self.close_unmatched()
            block = self.add("code_block", at)
            fence, block.fenced = m[1] or m[2], True
            block.data = {"char": fence[0], "length": len(fence), "indent": self.indent, "info": unescape(rest[len(fence) :].strip(" \t"))}
            self.to_end()
            return block
        if c == "<":
            for kind, pattern in enumerate(HTML_OPEN, 1):
                if pattern.match(rest) and (kind < 7 or container.kind != "paragraph" and not (not self.all_closed and self.tip.kind == "paragraph")):
                    self.close_unmatched()
                    block = self.add("html_block", at)
                    block.level = kind
                    return block
        if container.kind == "paragraph":
            if m := SETEXT.match(rest):
                self.take_references(container)
                if container.lines:
                    self.close_unmatched()
                    container.kind, container.level = "heading", 1 if m[1][0] == "=" else 2
                    offset, text = container.lines[-1]
                    container.lines[-1] = (offset, self.heading_attributes(container, text.rstrip(" \t")))
                    self.stretch(container)
                    return self.finished(container)
            if syntax.tables and len(container.lines) == 1 and self.table_begins(container, rest):
                return container
            if syntax.definition_list and re.match(r":[ \t]", rest):
                return self.definition(container, at)
        if RULE.match(rest):
            self.close_unmatched()
            return self.finished(self.add("rule", at))
        if syntax.footnotes and container.kind != "paragraph" and (m := FOOTNOTE.match(rest)):
            self.to_nonspace()
            self.advance(m.end())
            self.close_unmatched()
            block = self.add("footnote_definition", at)
            block.data = {"label": m[1], "width": 4}
            self.footnotes.add(normal_label(m[1]))
            return block
        if syntax.definition_list and re.match(r":[ \t]", rest) and container.kind != "paragraph" and (block := self.definition(container, at)):
            return block
        if data := self.marker(container.kind == "paragraph"):
            indent = self.indent
            self.to_nonspace()
            self.advance(data["length"])
            mark = self.column, self.offset, self.partial
            while self.column - mark[0] < 5 and self.at_space():
                self.advance(1, True)
            spaces = self.column - mark[0]
            if spaces >= 5 or spaces < 1 or self.offset >= len(self.line):
                self.column, self.offset, self.partial = mark
                spaces = 1
                if self.at_space():
                    self.advance(1, True)
            self.close_unmatched()
            if not (self.tip.kind == data["kind"] and self.tip.data["char"] == data["char"]):
                self.add(data["kind"], at).data = {"char": data["char"], "start": data["start"]}
            item = self.add("list_item", at)
            item.data = {"width": indent + data["length"] + spaces}
            return item
        return None

    def finished(self, block: Block) -> Block:
        self.to_end()
        self.close(block)
        self.tip.children[-1].blank = False
        block.open = False
        return block

    def heading_attributes(self, block: Block, body: str) -> str:
        if not self.syntax.heading_attributes or not (m := re.search(r"[ \t]*\{([^{}]*)\}$", body)):
            return body
        for word in m[1].split():
            if word[0] == "#" and len(word) > 1:
                block.id = word[1:]
            elif word[0] == "." and len(word) > 1:
                block.classes.append(word[1:])
            elif word[0] not in "#.":
                key, eq, value = word.partition("=")
                block.attrs.append((key, value if eq else None))
        return body[: m.start()]

    def table_begins(self, container: Block, rest: str) -> bool:
        """The paragraph's line becomes a table's head if `rest` is a delimiter row as wide."""
        head = container.lines[-1]
        if "-" not in rest or not TABLE_RULE.match(rest) or "|" not in rest + head[1]:
            return False
        cells = split_row(rest)
        if len(split_row(head[1])) != len(cells):
            return False
        self.close_unmatched()
        container.kind, container.data["begun"] = "table", True
        container.align = [("center" if x[-1] == ":" else "left") if x[0] == ":" and len(x) > 1 else "right" if x[-1] == ":" else "none" for _, x in cells]
        self.stretch(container)
        self.to_end()
        return True

    def definition(self, container: Block, at: int) -> Block | None:
        """`: text` after a paragraph, whose lines become titles, or after another definition."""
        if container.kind == "paragraph":
            self.close_unmatched()
            parent = container.parent
            titled = container
            self.tip = parent
        else:
            parent = container.parent if container.kind == "definition_list" else container
            titled = parent.children[-1] if parent.children else None
            if titled is None or titled.kind not in ("paragraph", "definition_list") or titled.kind == "paragraph" and len(titled.lines) != 1:
                return None
            self.close_unmatched()
        if titled.kind == "paragraph":
            titled.open = False
            holder = Block("definition_list", titled.start, parent)
            parent.children[parent.children.index(titled)] = holder
            for offset, text in titled.lines:
                title = Block("definition_list_title", offset, holder)
                title.lines, title.open, title.end = [(offset, text)], False, offset + len(text)
                holder.children.append(title)
        else:
            holder = titled
        holder.open, self.tip = True, holder
        self.to_nonspace()
        column, indent = self.column, self.indent
        self.advance(1)
        while self.column - column < 5 and self.at_space():
            self.advance(1, True)
        block = self.add("definition_list_definition", at)
        block.data = {"width": indent + self.column - column}
        return block


def split_row(line: str) -> list[tuple[int, str]]:
    """The cells of a table row with their offsets; escaped pipes do not part cells."""
    cells, start, i = [], 0, 0
    body = line.rstrip(" \t")
    if body.startswith("|"):
        start = i = 1
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            i += 2
            continue
        if body[i] == "|":
            cells.append((start, body[start:i]))
            start = i + 1
        i += 1
    if start < len(body) or not cells:
        cells.append((start, body[start:]))
    return [(at + len(x) - len(x.lstrip(" \t")), x.strip(" \t")) for at, x in cells]
