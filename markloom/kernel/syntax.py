"""Which extensions of the syntax a parse knows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True, slots=True)
class Syntax:
    gfm: bool = True
    tables: bool = True
    strikethrough: bool = True
    tasklists: bool = True
    footnotes: bool = True
    smart_punctuation: bool = False
    heading_attributes: bool = False
    math: bool = False
    definition_list: bool = False
    superscript: bool = False
    subscript: bool = False
    wikilinks: bool = False
    frontmatter: bool = False
