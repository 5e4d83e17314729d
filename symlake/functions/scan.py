"""State machines over source text: what built-in expressions cannot say. Plain Python, called from Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


_BRACKET = re.compile(r"[()\[\]{}]")


def blank(text: str) -> str:
    """As many spaces, with the newlines of the text."""
    return " " * len(text) if "\n" not in text else "\n".join(" " * len(line) for line in text.split("\n"))


@lru_cache(32)
def _lexis(line_comments: tuple[str, ...], block: tuple[str, str] | None, quotes: str, char_quote: bool) -> re.Pattern:
    """Comments (group c), characters (group k) and strings (group s); what opens first wins."""
    comments = [re.escape(c) + r"[^\n]*" for c in line_comments]
    if block:
        comments.append(rf"{re.escape(block[0])}(?s:.*?)(?:{re.escape(block[1])}|\Z)")
    strings, characters = [], []
    for q in quotes:
        if q == "'" and char_quote:
            characters.append(r"'(?:\\.[^']*|[^\\'])'")
        else:
            strings.append(rf"{q}(?:\\(?s:.)|[^\\{q}{'' if q == '`' else chr(92) + 'n'}])*(?:{q}|\\?)")
    parts = [f"(?P<{name}>{'|'.join(some)})" for name, some in (("c", comments), ("k", characters), ("s", strings)) if some]
    return re.compile("|".join(parts))


def _masked(m: re.Match) -> str:
    found = m.group()
    if m.lastgroup == "c":
        return blank(found)
    if len(found) > 1 and found[-1] == found[0] and "\\" not in found and "\n" not in found:
        return found[0] + " " * (len(found) - 2) + found[-1]
    inner = found[1:-1]
    if m.lastgroup == "k" or len(found) > 1 and found[-1] == found[0] and (len(inner) - len(inner.rstrip("\\"))) % 2 == 0:
        return found[0] + blank(inner) + found[-1]
    return found[0] + blank(found[1:])


def mask(text: str, line_comments: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'", char_quote: bool = False) -> str:
    """The text with the inside of strings and comments blanked; offsets and newlines stay.

    char_quote: a single quote opens only a character such as 'a' or '\\n' (so lifetimes and labels are left).
    """
    return _lexis(tuple(line_comments), block, quotes, char_quote).sub(_masked, text)


def brackets(masked: str) -> tuple[dict[int, int], bool]:
    """The closing position of every matched bracket, and whether any bracket is unmatched."""
    stack: list[int] = []
    pairs: dict[int, int] = {}
    broken = False
    for m in _BRACKET.finditer(masked):
        at = m.start()
        c = masked[at]
        if c in "([{":
            stack.append(at)
        elif stack and masked[stack[-1]] == CLOSERS[c]:
            pairs[stack.pop()] = at
        else:
            broken = True
            # drop openers that a later closer skips, so that outer scopes still close
            for k in range(len(stack) - 1, -1, -1):
                if masked[stack[k]] == CLOSERS[c]:
                    pairs[stack[k]] = at
                    del stack[k:]
                    break
    return pairs, broken or bool(stack)


@lru_cache(8)
def _breaks(text: str) -> list[int]:
    """Where the lines of a text end, without the last; found once for all places that are looked up in it."""
    return [m.start() for m in re.finditer("\n", text)]


def line_of(text: str, offset: int) -> int:
    return bisect_left(_breaks(text), offset) + 1


def line_at(text: str, offset: int, limit: int = 220) -> tuple[int, str]:
    """The line of an offset and its excerpt."""
    breaks = _breaks(text)
    k = bisect_left(breaks, offset)
    found = text[breaks[k - 1] + 1 if k else 0 : breaks[k] if k < len(breaks) else len(text)].strip()
    return k + 1, found if len(found) <= limit else found[:limit].strip() + " ..."


def lines_between(text: str, first: int, last: int) -> str:
    """Lines first to last (from 1), as far as there are such."""
    breaks = _breaks(text)
    first = max(1, first)
    if first > len(breaks) + 1 or last < first:
        return ""
    return text[breaks[first - 2] + 1 if first > 1 else 0 : breaks[last - 1] if last <= len(breaks) else len(text)]


def first_lines(text: str, limit: int = 10) -> str:
    lines = text.split("\n", limit)
    return "\n".join(lines[:limit]).rstrip() + "\n..." if len(lines) > limit else text.rstrip()


def excerpt(text: str, line: int, context: int = 0, limit: int = 220) -> str:
    """The lines around a line, trimmed and cut at a length."""
    found = lines_between(text, line - context, line + context).strip()
    return found if len(found) <= limit else found[:limit].strip() + " ..."


def brace_block(text: str, offset: int, limit: int = 18) -> str:
    """The construct from offset to the end of its balanced braces, at most so many lines; its surroundings if there is none."""
    masked = mask(text)
    pairs, _ = brackets(masked)
    opened = masked.find("{", offset)
    if opened < 0 or opened not in pairs:
        return excerpt(text, line_of(text, offset), 2)
    lines = text[offset : pairs[opened] + 1].split("\n")
    while len(lines) > 1 and (not lines[0].strip() or lines[0].strip() in ("}", "};", "public:", "private:", "protected:")):
        lines.pop(0)
    return first_lines("\n".join(lines), limit)


_NESTS = re.compile("[\"'`(\\[{<]")


def split_top(text: str, separator: str = ",") -> list[str]:
    """Splits at separators outside brackets, angle brackets and quotes; parts are trimmed, empty ones dropped."""
    if not _NESTS.search(text):  # closers without openers change nothing
        return [p for p in map(str.strip, text.split(separator)) if p]
    parts, depth, start, quote = [], 0, 0, ""
    for at, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[at - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and (at == 0 or text[at - 1] not in "-="):
            depth = max(0, depth - 1)
        elif c == separator and not depth:
            parts.append(text[start:at])
            start = at + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def parameter(raw: str, language: str) -> dict[str, str] | None:
    """Name and type of one parameter; None for receivers."""
    raw = next(iter(split_top(raw, "=")), "")
    if raw in ("self", "cls", "&self", "&mut self", "mut self", "void", "*", "/", "...") or not raw:
        return None
    if language in ("ts", "tsx", "script", "jsx", "python", "rust", "swift", "qml"):
        name, _, kind = raw.partition(":")
        words = _NAME.findall(name)
        return {"name": words[-1] if words else name.strip(), "type": kind.strip()}
    if language == "php":
        found = re.search(r"\$(\w+)", raw)
        return {"name": found.group(1) if found else raw, "type": raw[: found.start()].replace("&", "").replace("...", "").strip() if found else ""}
    if language == "objc":
        found = re.match(r"(?:\w+\s*:)?\s*\(([^)]*)\)\s*(\w+)", raw)
        if found:
            return {"name": found.group(2), "type": found.group(1).strip()}
    found = re.search(r"([A-Za-z_]\w*)\s*(?:\[\s*\])*$", raw)
    return {"name": found.group(1), "type": raw[: found.start()].strip()} if found else {"name": raw, "type": ""}


_OPENS = re.compile(r"\s*(?:<[^(]*>)?\s*(?:=\s*(?:async\s*)?(?:function\s*\w*\s*)?)?[:=]?\s*\(")


_QUOTED, _PLAIN = re.compile("[\"'/]"), re.compile(r"""[^()\[\]{}"'/]*\)""")
_TYPED, _RETURNED = re.compile(r"[ \t]*:[ \t]*([^={;\n]+)"), re.compile(r"\breturn\b[ \t]+([^;\n}]+)")


def signature(snippet: str, kind: str, name: str, language: str) -> tuple[list[dict[str, str]], list[str]]:
    """Parameters and return expressions or type of a callable's snippet."""
    if kind not in ("function", "method", "constructor", "hook") or not snippet:
        return [], []
    start, at = snippet.find(name), None
    while start >= 0 and not (at := _OPENS.match(snippet, start + len(name))):
        start = snippet.find(name, start + 1)
    parameters, kind_of = [], ""
    if at:
        opened = at.end() - 1
        plain = None if _QUOTED.search(snippet, 0, opened) else _PLAIN.match(snippet, opened + 1)
        if plain:  # nothing is quoted up to the bracket, and the next bracket closes it
            closed = plain.end() - 1
        else:
            closed = brackets(mask(snippet))[0].get(opened, len(snippet))
        parameters = [p for p in (parameter(x, language) for x in split_top(snippet[opened + 1 : closed])) if p]
        after = snippet[closed + 1 :]
        if language in ("ts", "tsx", "script", "jsx", "qml", "php"):
            found = _TYPED.match(after)
        elif language in ("python", "rust", "swift"):
            found = re.match(r"[ \t]*(?:async\s*)?(?:throws\s*)?->[ \t]*([^{;\n]+?)[ \t]*(?:[:{;\n]|where\b|$)", after)
        else:
            found = None
            before = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|\[[^\]]*\]\s*|template\s*<[^>]*>\s*)*", "", snippet[:start].split("\n")[-1].strip())
            before = " ".join(w for w in before.split() if w not in ("public", "private", "protected", "internal", "static", "final", "virtual", "inline", "async", "override", "abstract", "sealed", "synchronized", "extern", "constexpr", "explicit"))
            kind_of = before if kind != "constructor" else ""
        kind_of = found.group(1).strip() if found else kind_of
    if kind_of:
        return parameters, [kind_of]
    if kind == "constructor":
        return parameters, ["none"]
    found = list(dict.fromkeys(x.strip() for x in _RETURNED.findall(snippet)))[:3]
    return parameters, found or ["none"]


def tag_problems(html: str, skip_raw: bool = True) -> list[tuple[str, int, int]]:
    """Unclosed, unopened and mismatched tags as (message, line, column)."""
    # Tags without content.
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
    if skip_raw:
        blank = lambda m: re.sub(r"[^\n]", " ", m.group(0))
        html = re.sub(r"<!--.*?-->", blank, html, flags=re.S)
        html = re.sub(r"(?is)(<(script|style)\b[^>]*>)(.*?)(?=</\2\s*>)", lambda m: m.group(1) + re.sub(r"[^\n]", " ", m.group(3)), html)
    place = lambda at: (html.count("\n", 0, at) + 1, at - (html.rfind("\n", 0, at) + 1) + 1)
    stack: list[tuple[str, int]] = []
    out: list[tuple[str, int, int]] = []
    for m in re.finditer(r"<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", html):
        name = m.group(2).lower()
        if name in void or m.group(3).rstrip().endswith("/"):
            continue
        if not m.group(1):
            stack.append((name, m.start()))
        elif not stack:
            out.append((f"Unexpected closing tag </{name}>", *place(m.start())))
        else:
            opened, at = stack.pop()
            if opened != name:
                out.append((f"Mismatched closing tag </{name}>, expected </{opened}>", *place(m.start())))
    out += [(f"Unclosed tag <{name}>", *place(at)) for name, at in stack]
    return out


def expand_tabs(text: str, width: int = 2) -> str:
    return "\n".join(line.expandtabs(width) for line in text.split("\n"))
