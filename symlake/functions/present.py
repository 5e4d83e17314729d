"""Diagnostics and coloured HTML of snippets. Plain Python, called from Arrow batches."""

from __future__ import annotations

import html
import json
import re

from .scan import CLOSERS, OPENERS, mask, tag_problems

#: Problems shown for one snippet.
MOST = 8
# Words that are coloured, by language; any other language takes those of scripts.
SCRIPT_KEYWORDS = "function class const let var return if else for while switch case break continue import from export default extends implements interface type enum new this async await try catch finally throw null true false undefined"
KEYWORDS = {
    "php": "class function public private protected static return if else foreach for while extends implements interface trait const new namespace use null true false",
    "css": "@media @supports @keyframes display position color background font grid flex padding margin",
    "qml": "import property signal function readonly default required id anchors states transitions component onClicked onTriggered true false null",
    "json": "true false null",
    "python": "def class return if elif else for while import from as try except finally with lambda async await True False None",
    "cpp": "#include class struct namespace template return if else for while switch case public private protected const static virtual using auto nullptr",
    "java": "class interface enum record public private protected static return if else for while switch case new using import namespace throws async await null true false",
    "csharp": "class interface enum record public private protected static return if else for while switch case new using import namespace throws async await null true false",
    "rust": "fn struct enum trait impl pub let mut use mod crate self super match if else for while loop return async await const static",
    "objc": "@interface @implementation @property @protocol @end @class #import #include if else for while return nil self super static extern",
}
_SCRIPT_WORDS = frozenset(SCRIPT_KEYWORDS.split())
_WORDS = {language: frozenset(words.split()) for language, words in KEYWORDS.items()}


def _place(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1


def bracket_problems(text: str, language: str) -> list[tuple[str, int, int]]:
    masked = mask(text, ("#",) if language == "python" else ("//",), None if language == "python" else ("/*", "*/"), '"' if language == "rust" else "\"'`" if language in ("js", "jsx", "ts", "tsx") else "\"'")
    stack: list[int] = []
    out: list[tuple[str, int, int]] = []
    for at, c in enumerate(masked):
        if c in OPENERS:
            stack.append(at)
        elif c in CLOSERS:
            if stack and masked[stack[-1]] == CLOSERS[c]:
                stack.pop()
            else:
                out.append((f"Unexpected '{c}'", *_place(text, at)))
    out += [(f"Missing '{OPENERS[masked[at]]}'", *_place(text, at)) for at in stack]
    return sorted(set(out), key=lambda p: p[1:])[:MOST]


def json_problems(text: str) -> list[tuple[str, int, int]]:
    try:
        json.loads(text)
    except json.JSONDecodeError as problem:
        return [("JSON does not parse", problem.lineno, problem.colno)]
    return []


def diagnostics(snippet: str, language: str, mode: str, truncated: bool) -> list[tuple[str, int, int]]:
    """Warnings with line and column; none for blank or shortened snippets and where the mode is none."""
    if mode == "none" or truncated or not snippet.strip() or not language:
        return []
    if language == "html":
        return tag_problems(snippet)[:MOST]
    if language == "json":
        return json_problems(snippet)
    return bracket_problems(snippet, language)


def highlighted(text: str, language: str) -> str:
    """The text as HTML with spans of the classes comment, string, number, keyword, tag and attr."""
    span = lambda kind, x: f'<span class="{kind}">{html.escape(x, quote=False)}</span>'
    if language == "html":
        pattern = re.compile(r"(?P<comment><!--.*?-->)|(?P<tag></?[A-Za-z][\w:-]*|/?>)|(?P<attr>\b[\w:-]+(?==))|(?P<string>\"[^\"]*\"|'[^']*')", re.S)
    else:
        comment = r"\#[^\n]*|//[^\n]*|/\*.*?\*/" if language == "php" else r"/\*.*?\*/" if language == "css" else r"//[^\n]*|/\*.*?\*/"
        pattern = re.compile(rf"(?P<comment>{comment})|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<number>\b\d[\w.]*)|(?P<word>[@#]?[A-Za-z_]\w*)", re.S)
    words, out, at = _WORDS.get(language, _SCRIPT_WORDS if language != "html" else frozenset()), [], 0
    for m in pattern.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        kind = m.lastgroup
        out.append(span("keyword", m.group()) if kind == "word" and m.group() in words else html.escape(m.group(), quote=False) if kind == "word" else span(kind, m.group()))
        at = m.end()
    return "".join(out) + html.escape(text[at:], quote=False)
