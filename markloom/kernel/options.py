"""Options: validated when made, frozen, and captured by the plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from .syntax import Syntax

EXTRACT_KINDS = ("images", "links", "code_blocks", "headings", "footnote_definitions")
#: Nested groups: key -> (type, default). A list stands for an optional list of strings.
NESTED = {
    "headings": {"attributes": (bool, False), "ids": (bool, False)},
    "images": {"lazy": (bool, False), "allowed_hosts": (list, None), "allowed_schemes": (list, None)},
    "links": {"autolink": (bool, False), "nofollow": (bool, False), "allowed_hosts": (list, None), "allowed_schemes": (list, None)},
}
FLAGS_ON = ("gfm", "gfm_tag_filter", "tables", "strikethrough", "tasklists", "footnotes")
FLAGS_OFF = ("raw_html", "smart_punctuation", "emoji_shortcodes", "syntax_highlight", "hard_wrap", "statistics", "math", "definition_list", "superscript", "subscript", "wikilinks", "frontmatter")
RICH = {
    "smart_punctuation": True, "headings": {"attributes": False, "ids": True}, "images": {"lazy": True, "allowed_schemes": ["http", "https"]},
    "links": {"autolink": True, "nofollow": True, "allowed_schemes": ["http", "https", "mailto"]}, "emoji_shortcodes": True,
    "syntax_highlight": True, "hard_wrap": True, "frontmatter": True,
}
PRESETS: dict[str, dict] = {
    "commonmark": dict.fromkeys(FLAGS_ON, False),
    "gfm": dict.fromkeys(FLAGS_ON, True),
    "recommended": RICH | {"raw_html": False},
    "trusted": RICH | {"raw_html": True},
}


def checked(key: str, value: object) -> object:
    """The value in its stored form; ValueError if it does not fit the key."""
    if key in FLAGS_ON or key in FLAGS_OFF:
        if not isinstance(value, bool):
            raise ValueError(f"invalid value for {key}: got {type(value).__name__} ({value!r}), expected a bool")
    elif key in NESTED:
        if not isinstance(value, dict):
            raise ValueError(f"invalid value for {key}: got {type(value).__name__} ({value!r}), expected a dict")
        if unknown := [k for k in value if k not in NESTED[key]]:
            raise ValueError(f"unknown {key} key(s): {unknown}; expected one of {list(NESTED[key])}")
        for k, v in value.items():
            kind = NESTED[key][k][0]
            if not (isinstance(v, bool) if kind is bool else v is None or isinstance(v, list | tuple)):
                raise ValueError(f"invalid value for {key}[{k!r}]: got {type(v).__name__} ({v!r})")
    elif key == "toc":
        if isinstance(value, dict):
            if unknown := [k for k in value if k != "depth"]:
                raise ValueError(f"unknown toc key(s): {unknown}; expected depth")
            depth = value.get("depth")
            if depth is not None and (isinstance(depth, bool) or not isinstance(depth, int) or not 1 <= depth <= 6):
                raise ValueError(f"invalid value for toc depth: got {depth!r}, expected None or Integer 1..6")
        elif not isinstance(value, bool):
            raise ValueError(f"invalid value for toc: got {value!r}")
    elif key == "extract":
        if value is not None and not isinstance(value, dict):
            raise ValueError(f"invalid value for extract: got {value!r}")
        for kind, on in (value or {}).items():
            if kind not in EXTRACT_KINDS:
                raise ValueError(f"unknown extract kind: {kind!r}; expected one of {EXTRACT_KINDS}")
            if not isinstance(on, bool):
                raise ValueError(f"invalid value for extract[{kind!r}]: got {on!r}, expected a bool")
    else:
        raise ValueError(f"unknown option: {key!r}")
    return value


def frozen(key: str, value: object) -> object:
    if key in NESTED:
        full = {k: d for k, (_, d) in NESTED[key].items()} | value
        return tuple(sorted((k, tuple(v) if isinstance(v, list | tuple) else v) for k, v in full.items()))
    if key == "extract":
        return None if value is None else tuple(sorted(value.items()))
    return value


@dataclass(frozen=True)
class Options:
    """All options. Nested groups are held as sorted pairs, so that equal options are equal."""

    flags: tuple = ()
    headings: tuple = field(default_factory=lambda: frozen("headings", {}))
    images: tuple = field(default_factory=lambda: frozen("images", {}))
    links: tuple = field(default_factory=lambda: frozen("links", {}))
    toc: bool = False
    toc_depth: int | None = None
    extract: tuple | None = None

    @classmethod
    def of(cls, preset: str | None = None, **overrides: object) -> Options:
        """Defaults, then the preset, then the overrides; nested groups merge key by key."""
        if preset is not None and preset not in PRESETS:
            raise ValueError(f"unknown preset: {preset!r}; expected one of {list(PRESETS)}")
        return cls(flags=tuple((k, k in FLAGS_ON) for k in FLAGS_ON + FLAGS_OFF)).merge(**(PRESETS[preset] if preset else {})).merge(**overrides)

    def merge(self, **overrides: object) -> Options:
        """These options with others on top."""
        flags, more = dict(self.flags), {}
        for key, value in overrides.items():
            checked(key, value)
            if key in flags:
                flags[key] = value
            elif key in NESTED:
                more[key] = frozen(key, dict(getattr(self, key)) | value)
            elif key == "toc":
                more["toc"] = value if isinstance(value, bool) else True
                if isinstance(value, dict):
                    more["toc_depth"] = value.get("depth")
            else:
                more[key] = frozen(key, value)
        return replace(self, flags=tuple(flags.items()), **more)

    @cached_property
    def _flags(self) -> dict[str, bool]:
        return dict(self.flags)

    def __getitem__(self, key: str) -> object:
        if key in self._flags:
            return self._flags[key]
        if key in NESTED:
            return {k: list(v) if isinstance(v, tuple) else v for k, v in getattr(self, key)}
        if key in ("toc", "toc_depth"):
            return getattr(self, key)
        if key == "extract":
            return None if self.extract is None else dict(self.extract)
        raise ValueError(f"unknown option: {key!r}")

    def to_dict(self) -> dict:
        """User-facing keys. As in merge(), the toc depth stays with the options it was set on."""
        return {k: self[k] for k in (*dict(self.flags), *NESTED, "toc", "extract")}

    def syntax(self) -> Syntax:
        return self._syntax

    @cached_property
    def _syntax(self) -> Syntax:
        names = {f.name for f in fields(Syntax)}
        return Syntax(**{k: v for k, v in self.flags if k in names}, heading_attributes=self["headings"]["attributes"])

    def collecting(self) -> Options:
        """What collecting implies: statistics need a table of contents, that needs heading records,
        and both need heading ids."""
        toc = self.toc or self["statistics"] or dict(self.extract or ()).get("headings", False)
        if not toc:
            return self
        return self.merge(toc=True, headings={"ids": True}, extract=dict(self.extract or ()) | {"headings": True})


_default = Options.of()


def default_options() -> Options:
    """The process's defaults, read when a plan is made and never on executors."""
    return _default


def configure(**overrides: object) -> Options:
    global _default
    _default = _default.merge(**overrides)
    return _default


def resolve(options: Options | dict | str | None) -> Options:
    if options is None:
        return _default
    if isinstance(options, Options):
        return options
    if isinstance(options, str):
        return Options.of(preset=options)
    if isinstance(options, dict):
        return Options.of(**options)
    raise TypeError(f"options must be Options, a dict, a preset name or None, got {type(options).__name__}")


def is_whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


@dataclass(frozen=True)
class Budget:
    """How many characters or words a piece may hold, and where it may be cut."""

    chars: int | None = None
    words: int | None = None
    at: str = "block"

    def __post_init__(self) -> None:
        """Raises ValueError with everything that is wrong."""
        if wrong := list(self.problems()):
            raise ValueError(f"{type(self).__name__}: {'; '.join(wrong)}")

    def problems(self) -> Iterator[str]:
        given = {name: n for name in ("chars", "words") if (n := getattr(self, name)) is not None}
        if not given:
            yield "give a budget: chars, words or both"
        yield from (f"{name}={n!r} is not an int" for name, n in given.items() if not is_whole(n))
        if self.at not in ("block", "word"):
            yield f"at={self.at!r} is neither 'block' nor 'word'"


@dataclass(frozen=True)
class Truncate(Budget):
    marker: str | None = "…"

    def problems(self) -> Iterator[str]:
        yield from super().problems()
        if self.marker is None:
            return
        if not isinstance(self.marker, str):
            yield f"marker={self.marker!r} is neither a str nor None"
        elif self.marker and is_whole(self.chars) and len(self.marker) >= self.chars:
            yield f"a marker of {len(self.marker)} characters leaves no room in {self.chars}"

    @classmethod
    def of(cls, params: Truncate | dict | None) -> Truncate | None:
        if params is None or isinstance(params, Truncate):
            return params
        if not isinstance(params, dict):
            raise TypeError(f"a truncation is a Truncate or a dict, not a {type(params).__name__}")
        if unknown := sorted(set(params) - {f.name for f in fields(cls)}):
            raise ValueError(f"Truncate has no {', '.join(unknown)}")
        return cls(**params)


@dataclass(frozen=True)
class Windows(Budget):
    overlap: int = 0

    def problems(self) -> Iterator[str]:
        yield from super().problems()
        yield from (f"{name}={n} leaves no room" for name in ("chars", "words") if is_whole(n := getattr(self, name)) and n <= 0)
        if not is_whole(self.overlap):
            yield f"overlap={self.overlap!r} is not an int"
        elif self.overlap < 0 or is_whole(self.chars) and self.overlap >= self.chars:
            yield f"overlap={self.overlap} is not from 0 up to below chars"
