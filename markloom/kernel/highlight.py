"""Highlighted code. Token classes come from Pygments where it is installed, else code is plain."""

from __future__ import annotations

import re

from .html import escape, escape_text

try:
    import pygments.formatters
    import pygments.lexers
    import pygments.styles
    import pygments.token
    import pygments.util
except ImportError:
    pygments = None

#: The theme that stands for a name of the original set.
THEMES = {"base16-ocean.dark": "nord", "base16-ocean.light": "default", "InspiredGitHub": "friendly", "Solarized (dark)": "solarized-dark", "Solarized (light)": "solarized-light", "base16-eighties.dark": "monokai", "base16-mocha.dark": "gruvbox-dark"}
DEFAULT_THEME = "base16-ocean.dark"


def token_class(kind: object) -> str:
    while kind not in pygments.token.STANDARD_TYPES:
        kind = kind.parent
    return pygments.token.STANDARD_TYPES[kind]


def coloured(line: list[tuple[str, str]]) -> str:
    return "".join(f'<span class="{c}">{escape_text(x)}</span>' if c else escape_text(x) for c, x in line)


def highlighted(code: str, info: str) -> str:
    """One HTML block: each line that is not empty in a span; blank lines go."""
    lines: list[list[tuple[str, str]]] = [[]]
    tokens: list[tuple[str, str]] = [("", code)]
    if pygments:
        try:
            lexer = pygments.lexers.get_lexer_by_name(re.split(r"[\s,{]", info, maxsplit=1)[0], stripnl=False, ensurenl=False)
            tokens = [(token_class(t), x) for t, x in lexer.get_tokens(code)]
        except pygments.util.ClassNotFound:
            pass
    for name, text in tokens:
        for k, part in enumerate(text.split("\n")):
            if k:
                lines.append([])
            if part:
                lines[-1].append((name, part))
    body = "\n".join(f'<span class="line">{coloured(x)}</span>' for x in lines if "".join(t for _, t in x).strip())
    return f'<pre><code class="language-{escape(info)}">{body}</code></pre>'


def highlight_themes() -> tuple[str, ...]:
    return tuple(sorted(THEMES))


def highlight_css(theme: str | None = None) -> str:
    """The style sheet of a theme."""
    theme = DEFAULT_THEME if theme is None else theme
    if theme not in THEMES:
        raise ValueError(f"unknown theme: {theme!r}; expected one of {highlight_themes()}")
    if not pygments:
        return f"/* {theme} */\npre code .line {{ display: block; }}\n"
    name = THEMES[theme] if THEMES[theme] in set(pygments.styles.get_all_styles()) else "default"
    return pygments.formatters.HtmlFormatter(style=name).get_style_defs("pre code") + "\n"
