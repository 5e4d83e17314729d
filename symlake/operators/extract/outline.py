"""A scope tree of declarations for languages with braces, from masked text and matched brackets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ...functions.scan import brackets, first_lines, line_of, mask

TYPES = ("class", "interface", "trait", "struct", "enum", "record", "protocol", "impl", "module", "extension", "actor", "namespace")
CALLABLES = ("function", "method", "constructor", "initializer", "deinitializer", "hook", "component")


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    line: int
    snippet: str = ""
    detail: str = ""
    body: tuple[int, int] | None = None
    members: list[Symbol] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    source_mode: str = ""


@dataclass
class Rule:
    """A declaration: a pattern with the group `name`; body: it may open a block."""

    kind: str
    pattern: re.Pattern
    body: bool = True
    #: where it counts: top (no scope), type (in a type), any (top or in a type)
    where: str = "any"
    detail: Callable[[re.Match], str] | None = None


@dataclass
class Grammar:
    rules: list[Rule]
    line_comments: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    char_quote: bool = False
    #: kind of a function in a type of that name or with such a name
    constructor: tuple[str, str] = ("", "")
    control: frozenset[str] = frozenset()
    #: scopes that are walked through without becoming symbols
    through: tuple[str, ...] = ("namespace",)


def _end_of(masked: str, pairs: dict[int, int], at: int) -> tuple[int, tuple[int, int] | None]:
    """Where a declaration that is at `at` ends, and its block."""
    while at < len(masked):
        c = masked[at]
        if c == "{":
            end = pairs.get(at, len(masked) - 1)
            return end + 1, (at + 1, end)
        if c in "([" and at in pairs:
            at = pairs[at]
        elif c == ";":
            return at + 1, None
        elif c == "=" and masked[at : at + 2] == "=>":
            end = masked.find(";", at)
            return (end + 1 if end >= 0 else len(masked)), (at + 2, end if end >= 0 else len(masked))
        elif c == "}":
            return at, None
        at += 1
    return len(masked), None


CALL = re.compile(r"([A-Za-z_]\w*)\s*!?\s*\(")


def call_names(masked: str) -> list[str]:
    return list(dict.fromkeys(CALL.findall(masked)))


def outline(text: str, grammar: Grammar, lenient: bool = False) -> tuple[list[Symbol], bool]:
    """Top-level symbols with members, and whether brackets are broken.

    lenient: functions inside functions count too, as members of the nearest type or at the top; so
    declarations after a missing bracket are found.
    """
    masked = mask(text, grammar.line_comments, grammar.block, grammar.quotes, grammar.char_quote)
    pairs, broken = brackets(masked)
    found: list[Symbol] = []
    taken: set[int] = set()
    for rule in grammar.rules:
        for m in rule.pattern.finditer(masked):
            name_at = m.start("name")
            name = text[name_at : m.end("name")]
            if name_at in taken or name in grammar.control:
                continue
            taken.add(name_at)
            start = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
            end, body = _end_of(masked, pairs, m.end()) if rule.body else (_line_end(masked, pairs, m.end()), None)
            one = Symbol(rule.kind, name, start, end, line_of(text, start), first_lines(text[start:end]), rule.detail(m) if rule.detail else "", body)
            one.where = rule.where  # type: ignore[attr-defined]
            found.append(one)
    found.sort(key=lambda s: (s.start, -s.end))
    top: list[Symbol] = []
    stack: list[Symbol] = []
    for s in found:
        while stack and not (stack[-1].body and stack[-1].body[0] <= s.start < stack[-1].body[1]):
            stack.pop()
        holder = next((x for x in reversed(stack) if x.kind not in grammar.through), None)
        local = holder is not None and holder.kind not in TYPES
        if local and lenient:
            holder = next((x for x in reversed(stack) if x.kind in TYPES and x.kind not in grammar.through), None)
            local = s.kind not in (*CALLABLES, *TYPES)
        where = s.where  # type: ignore[attr-defined]
        if local or (where == "top" and holder is not None) or (where == "type" and holder is None):
            if s.body and not local:
                stack.append(s)
            continue
        if holder is not None and s.kind == "function":
            is_constructor = s.name == grammar.constructor[0] or (grammar.constructor[0] == "=" and s.name == holder.name)
            s.kind = grammar.constructor[1] if is_constructor else "method"
        if s.kind not in grammar.through:
            (top if holder is None else holder.members).append(s)
        if s.body:
            stack.append(s)
        if s.kind in CALLABLES and s.body:
            s.calls = [c for c in call_names(masked[s.body[0] : s.body[1]]) if c not in grammar.control and c != s.name]
    return top, broken


def _line_end(masked: str, pairs: dict[int, int], at: int) -> int:
    """The end of a declaration without a block of its own: after brackets, at a semicolon or line end."""
    while at < len(masked) and masked[at] not in ";\n":
        at = pairs.get(at, at) + 1 if masked[at] in "([{" else at + 1
    return min(at + 1, len(masked)) if at < len(masked) and masked[at] == ";" else at
