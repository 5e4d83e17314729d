"""Recognisers: what counts as a declaration in each language."""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from itertools import accumulate, chain

from ...functions.scan import brackets, excerpt, first_lines, line_of, mask
from ...schemas import CONTROL_WORDS
from .outline import Grammar, Rule, Symbol, call_names, outline

_R = re.compile
_CONTROL = frozenset(CONTROL_WORDS) | {"elif", "with", "match", "foreach", "using", "lock", "new", "await", "sizeof", "guard", "catch", "throw", "super", "this"}


def _modifiers(*words: str):
    def detail(m: re.Match) -> str:
        return ", ".join(w for w in re.findall(r"\b(\w+)\b", m.group("mod") or "") if w in words)

    return detail


_JAVA_MOD = r"(?P<mod>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp)\s+)*)"
_java = _modifiers("public", "private", "protected", "static", "final", "abstract")
JAVA = Grammar(
    [
        Rule("class", _R(r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*" + _JAVA_MOD + r"class\s+(?P<name>\w+)"), detail=_java),
        Rule("interface", _R(r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*" + _JAVA_MOD + r"@?interface\s+(?P<name>\w+)"), detail=_java),
        Rule("enum", _R(r"(?m)^[ \t]*(?:@\w+\s*)*" + _JAVA_MOD + r"enum\s+(?P<name>\w+)"), detail=_java),
        Rule("record", _R(r"(?m)^[ \t]*(?:@\w+\s*)*" + _JAVA_MOD + r"record\s+(?P<name>\w+)(?=\s*[(<])"), detail=_java),
        Rule("function", _R(r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*" + _JAVA_MOD + r"(?:<[^>\n]+>\s+)?(?!return\b|new\b|else\b|throw\b)[\w.]+(?:<[^;{}()\n]*>)?(?:\[\])*\s+(?P<name>\w+)\s*(?=\()"), where="type", detail=_java),
        Rule("function", _R(r"(?m)^[ \t]*(?:@\w+\s*)*" + _JAVA_MOD + r"(?P<name>[A-Z]\w*)\s*(?=\([^;{}]*\)\s*(?:throws[\w\s,.]+)?\{)"), where="type", detail=_java),
        Rule("constant", _R(r"(?m)^[ \t]*(?P<mod>(?:(?:public|private|protected)\s+)?(?:static\s+final|final\s+static)\s+)[\w.<>\[\], ]+?\s+(?P<name>\w+)\s*(?==)"), body=False, where="type", detail=_java),
        Rule("property", _R(r"(?m)^[ \t]*(?:@\w+\s*)*" + _JAVA_MOD + r"(?!return\b|throw\b|package\b|import\b|goto\b|break\b|continue\b)[\w.]+(?:<[^;{}()\n]*>)?(?:\[\])*[ \t]+(?P<name>\w+)[ \t]*(?=[=;])"), body=False, where="type", detail=_java),
        Rule("variant", _R(r"(?m)(?:(?<=\{)|(?<=,)|^)\s*(?P<name>[A-Z][A-Z0-9_]*)\s*(?=[,;}(\n])"), body=False, where="enum"),
    ],
    constructor=("=", "constructor"), control=_CONTROL,
)

_CS_MOD = r"(?P<mod>(?:(?:public|private|protected|internal|static|sealed|abstract|virtual|override|async|readonly|partial|extern|unsafe|new)\s+)*)"
_cs = _modifiers("public", "private", "protected", "internal", "static", "sealed", "abstract", "virtual", "override", "async", "readonly", "partial")
CSHARP = Grammar(
    [
        Rule("namespace", _R(r"(?m)^[ \t]*namespace\s+(?P<name>[\w.]+)(?=\s*\{)")),
        *(Rule(k, _R(r"(?m)^[ \t]*(?:\[[^\]\n]*\]\s*)*" + _CS_MOD + k + r"\s+(?!struct\b|class\b)(?P<name>\w+)"), detail=_cs) for k in ("class", "interface", "struct", "enum", "record")),
        Rule("function", _R(r"(?m)^[ \t]*(?:\[[^\]\n]*\]\s*)*" + _CS_MOD + r"(?!return\b|new\b|else\b|throw\b|await\b)[\w.]+(?:<[^;{}()\n]*>)?(?:\[\])*\??\s+(?P<name>\w+)\s*(?:<[^>\n]*>)?(?=\()"), where="type", detail=_cs),
        Rule("function", _R(r"(?m)^[ \t]*(?:\[[^\]\n]*\]\s*)*" + _CS_MOD + r"(?P<name>[A-Z]\w*)\s*(?=\([^;{}]*\)\s*(?::\s*(?:base|this)[^{]*)?\{)"), where="type", detail=_cs),
        Rule("property", _R(r"(?m)^[ \t]*(?:\[[^\]\n]*\]\s*)*" + _CS_MOD + r"(?!return\b|throw\b|using\b|namespace\b|class\b|struct\b|enum\b|interface\b|record\b)[\w.]+(?:<[^;{}()\n]*>)?(?:\[\])*\??[ \t]+(?P<name>\w+)\s*(?=\{\s*(?:\w+\s+)?(?:get|set|init)\b|=|;)"), body=False, where="type", detail=_cs),
    ],
    constructor=("=", "constructor"), control=_CONTROL,
)

_pub = lambda m: "public" if re.search(r"\bpub\b", m.group(0)) else ""
RUST = Grammar(
    [
        Rule("impl", _R(r"(?m)^[ \t]*(?:unsafe\s+)?impl(?:<[^{>]*>)?\s+(?P<name>[\w:<>, ']+?(?:\s+for\s+[\w:<>, ']+?)?)\s*(?=\{|\bwhere\b)")),
        *(Rule(k, _R(r"(?m)^[ \t]*(?:#\[[^\]\n]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?" + k + r"\s+(?P<name>\w+)"), detail=_pub) for k in ("struct", "enum", "trait")),
        Rule("module", _R(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)(?=\s*\{)"), detail=_pub),
        Rule("function", _R(r"(?m)^[ \t]*(?:#\[[^\]\n]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)"), detail=_pub),
        Rule("constant", _R(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z]\w*)\s*(?=:)"), body=False, detail=_pub),
        Rule("variant", _R(r"(?m)(?:(?<=\{)|(?<=,)|^)\s*(?P<name>[A-Z]\w*)\s*(?=[,}({\n])"), body=False, where="enum"),
    ],
    char_quote=True, control=_CONTROL,
)

_PHP_MOD = r"(?P<mod>(?:(?:public|private|protected|static|final|abstract|readonly|var)\s+)*)"
_php = _modifiers("public", "private", "protected", "static", "final", "abstract")
PHP = Grammar(
    [
        *(Rule(k, _R(r"(?mi)^[ \t]*(?P<mod>(?:(?:abstract|final|readonly)\s+)*)" + k + r"\s+(?P<name>\w+)"), detail=_php) for k in ("class", "interface", "trait", "enum")),
        Rule("function", _R(r"(?mi)^[ \t]*" + _PHP_MOD + r"function\s+&?\s*(?P<name>\w+)\s*(?=\()"), detail=_php),
        Rule("property", _R(r"(?m)^[ \t]*(?P<mod>(?:(?:public|private|protected|static|readonly|var)\s+)+)(?:[?\w\\|]+\s+)?\$(?P<name>\w+)"), body=False, where="type", detail=_php),
        Rule("constant", _R(r"(?m)^[ \t]*(?P<mod>(?:(?:public|private|protected|final)\s+)*)const\s+(?:\w+\s+)?(?P<name>[A-Z]\w*)\s*(?==)"), body=False, detail=_php),
    ],
    line_comments=("//", "#"), constructor=("__construct", "constructor"), control=_CONTROL,
)

SWIFT = Grammar(
    [
        *(Rule(k, _R(r"(?m)^[ \t]*(?:@\w+\s+)*(?:(?:public|private|internal|open|fileprivate|final|indirect)\s+)*" + k + r"\s+(?!func\b|var\b|let\b)(?P<name>[\w.]+)")) for k in ("class", "struct", "enum", "extension", "actor", "protocol")),
        Rule("function", _R(r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|open|fileprivate|static|class|final|override|mutating|async)\s+)*func\s+(?P<name>\w+)")),
        Rule("initializer", _R(r"(?m)^[ \t]*(?:(?:public|private|internal|required|convenience|override)\s+)*(?P<name>init)\b[?!]?(?=\s*[(<])"), where="type"),
        Rule("deinitializer", _R(r"(?m)^[ \t]*(?P<name>deinit)\b"), where="type"),
        Rule("associatedtype", _R(r"(?m)^[ \t]*associatedtype\s+(?P<name>\w+)"), body=False, where="type"),
        Rule("typealias", _R(r"(?m)^[ \t]*(?:(?:public|private|internal)\s+)?typealias\s+(?P<name>\w+)"), body=False),
        Rule("property", _R(r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|open|fileprivate|static|class|lazy|weak|final|override)(?:\(set\))?\s+)*(?:var|let)\s+(?P<name>\w+)"), body=False),
        Rule("variant", _R(r"(?m)^[ \t]*(?:indirect\s+)?case\s+(?P<name>[a-z]\w*)(?=\s*(?:[,(=\n]|$))"), body=False, where="enum"),
    ],
    quotes='"', control=_CONTROL,
)

CPP = Grammar(
    [
        Rule("class", _R(r"(?m)^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?:\w+\s+)?(?P<name>(?!final\b)\w+)(?=\s*(?:final\s*)?(?::[^:;{][^;{]*)?\{)")),
        Rule("function", _R(r"(?m)^[ \t]*(?:template\s*<[^>]*>\s*)?(?:(?:inline|static|constexpr|virtual|explicit|extern|friend)\s+)*(?!return\b|else\b|new\b|delete\b|throw\b|case\b)[A-Za-z_][\w:<>,&*~ \t]*?[\s&*]+(?:\w+::)*(?P<name>~?\w+)\s*(?=\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?:->[^;{]*)?(?:\{|$))"), where="any"),
    ],
    control=_CONTROL,
)

JS_LEXIS = {"quotes": "\"'`"}


def _flat(symbols: list[Symbol], names: set[str]) -> list[Symbol]:
    return [s for s in symbols if not (s.name in names or names.add(s.name))]


def _line_stop(masked: str, at: int) -> int:
    end = masked.find("\n", at)
    return end if end >= 0 else len(masked)


def _nesting(masked: str, pairs: dict[int, int]):
    """A function that says whether matched braces are open at a position."""
    turns = sorted([(a + 1, 1) for a in pairs if masked[a] == "{"] + [(b, -1) for a, b in pairs.items() if masked[a] == "{"])
    places, depths = [at for at, _ in turns], list(accumulate(n for _, n in turns))
    return lambda at: (k := bisect_right(places, at)) > 0 and depths[k - 1] > 0


# Declarations of scripts by kind, with the words that stand after the head; without such words the pattern looks for exports.
_HEAD = r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?"
_SCRIPT_RULES = [
    ("function", ("async", "function"), _R(_HEAD + r"(?:async\s+)?function\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*(?=\()")),
    ("class", ("abstract", "class"), _R(_HEAD + r"(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)")),
    ("object", ("const", "let", "var"), _R(_HEAD + r"(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?=\{)")),
    ("exports", (), _R(r"(?m)^[ \t]*(?P<name>module\.exports)\s*=\s*(?=\{)")),
    ("function", ("const", "let", "var"), _R(_HEAD + r"(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?=(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?|[A-Za-z_$][\w$]*\s*)=>)")),
    ("function", ("const", "let", "var"), _R(_HEAD + r"(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?=function\b)")),
    ("function", (), _R(r"(?m)^[ \t]*(?:module\.)?exports\.(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?=(?:async\s*)?(?:function\b|\())")),
    ("props", ("interface",), _R(_HEAD + r"interface\s+(?P<name>[A-Za-z_$][\w$]*)")),
    ("enum", ("const", "enum"), _R(_HEAD + r"(?:const\s+)?enum\s+(?P<name>[A-Za-z_$][\w$]*)")),
    ("type", ("type",), _R(_HEAD + r"type\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*(?==)")),
    ("variable", ("const", "let", "var"), _R(_HEAD + r"(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?=[=:;\n])")),
]
_ARROW = next(pattern for _, _, pattern in _SCRIPT_RULES if "=>" in pattern.pattern)
_DECLARED = _R(_HEAD + r"(?=(async|function|abstract|class|const|let|var|interface|enum|type)\b)")


def _declared(masked: str) -> list[tuple[str, list[re.Match]]]:
    """Each rule with the matches that finditer would give; the words are looked up once, then only their rules are tried."""
    heads: dict[str, list[int]] = {}
    for m in _DECLARED.finditer(masked):
        heads.setdefault(m.group(1), []).append(m.start())
    exports, arrows, out = "exports" in masked, "=>" in masked, []
    for kind, words, pattern in _SCRIPT_RULES:
        if not words and exports:
            out.append((kind, list(pattern.finditer(masked))))
        some = [heads[word] for word in words if word in heads]
        if not some or pattern is _ARROW and not arrows:
            continue
        found, end = [], 0
        for at in some[0] if len(some) == 1 else sorted(chain.from_iterable(some)):
            if at >= end and (m := pattern.match(masked, at)):
                found.append(m)
                end = m.end()
        out.append((kind, found))
    return out


def script(text: str, language: str, lenient: bool = False) -> tuple[list[Symbol], bool]:
    """JS, JSX, TS and TSX: functions, classes, object literals, arrows, interfaces and types.

    Declarations at any depth count in script and jsx (and when lenient); in ts and tsx only those at the top.
    """
    masked = mask(text, **JS_LEXIS)
    pairs, broken = brackets(masked)
    react = language in ("jsx", "tsx")
    depth_free = lenient or language in ("script", "jsx")
    nested = _nesting(masked, pairs)
    found: list[Symbol] = []
    for kind, matches in _declared(masked):
        for m in matches:
            name, start, whole = m.group("name"), m.start(), m.group()
            start += len(whole) - len(whole.lstrip())
            if name in _CONTROL or (nested(m.start("name")) and (not depth_free or kind == "variable")):
                continue
            at = masked.find("{", m.end())
            stop = masked.find(";", m.end())
            body = (at + 1, pairs.get(at, len(masked))) if at >= 0 and (stop < 0 or at < stop or kind in ("class", "props", "enum")) and kind not in ("variable", "type") else None
            end = body[1] + 1 if body else (stop + 1 if stop >= 0 else _line_stop(masked, m.end()))
            if kind == "function" and not body:
                body = (m.end(), end)
            if kind == "exports":
                found += object_members(text, masked, pairs, body) if body else []
                found.append(Symbol("module", "module.exports", start, end, line_of(text, start), first_lines(text[start:end]), members=object_members(text, masked, pairs, body) if body else []))
                continue
            one = Symbol({"object": "variable"}.get(kind, kind), name, start, end, line_of(text, start), first_lines(text[start:end]), body=body)
            if kind == "function":
                one.kind = "component" if react and name[:1].isupper() else "hook" if name.startswith("use") and re.match(r"use[A-Z]", name) else "function"
                one.calls = [c for c in call_names(masked[m.end() : end]) if c not in _CONTROL and c != name]
            elif kind == "class" and body:
                one.members = class_members(text, masked, pairs, body)
            elif kind == "object" and body:
                one.members = object_members(text, masked, pairs, body)
            found.append(one)
    return sorted(_flat(found, set()), key=lambda s: s.start), broken


def _direct(masked: str, pairs: dict[int, int], body: tuple[int, int]) -> str:
    """The text of a block with all inner blocks blanked."""
    out, at = [], body[0]
    while (opened := masked.find("{", at, body[1])) >= 0:
        if opened in pairs and pairs[opened] <= body[1]:
            out += [masked[at : opened + 1], " " * (pairs[opened] - opened - 1), "}"]
            at = pairs[opened] + 1
        else:
            out.append(masked[at : opened + 1])
            at = opened + 1
    return "".join([*out, masked[at : body[1]]])


def _member(text: str, masked: str, pairs: dict[int, int], base: int, m: re.Match, kind: str) -> Symbol:
    start = base + m.start() + len(m.group(0)) - len(m.group(0).lstrip())
    at = masked.find("{", base + m.end())
    gap = masked[base + m.end() : at] if at >= 0 else ";"
    block = at >= 0 and at in pairs and not re.search(r"[;}]", gap) and kind != "property"
    end = pairs[at] + 1 if block else base + m.end()
    one = Symbol(kind, m.group("name"), start, end, line_of(text, start), first_lines(text[start:end]), body=(at + 1, pairs[at]) if block else None)
    one.calls = [c for c in call_names(masked[at + 1 : pairs[at]]) if c not in _CONTROL and c != one.name] if block else []
    return one


def class_members(text: str, masked: str, pairs: dict[int, int], body: tuple[int, int]) -> list[Symbol]:
    flat = _direct(masked, pairs, body)
    rules = [
        ("method", _R(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*\*?#?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*(?=\([^;]*?\)\s*(?::[^{;]+)?\{)")),
        ("method", _R(r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n;]+)?=\s*(?:async\s*)?(?=\([^()]*\)\s*=>)")),
        ("property", _R(r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*#?(?P<name>[A-Za-z_$][\w$]*)[?!]?\s*(?=[:=;])")),
    ]
    found = [_member(text, masked, pairs, body[0], m, "constructor" if kind == "method" and m.group("name") == "constructor" else kind) for kind, p in rules for m in p.finditer(flat) if m.group("name") not in _CONTROL]
    own = _R(r"(?m)^[ \t]*this\.(?P<name>[A-Za-z_$][\w$]*)\s*(?==[^=])")
    found += [_member(text, masked, pairs, body[0], m, "property") for m in own.finditer(masked[body[0] : body[1]])]
    return sorted(_flat(found, set()), key=lambda s: s.start)


def object_members(text: str, masked: str, pairs: dict[int, int], body: tuple[int, int]) -> list[Symbol]:
    flat = _direct(masked, pairs, body)
    key = r"(?:(?<=[{,])|^)\s*"
    rules = [
        ("method", _R(r"(?m)" + key + r"(?:async\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*(?=\([^;{}]*\)\s*\{)")),
        ("method", _R(r"(?m)" + key + r"[\"']?(?P<name>[A-Za-z_$][\w$]*)[\"']?\s*:\s*(?:async\s*)?(?=(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>|function\b)")),
        ("property", _R(r"(?m)" + key + r"[\"']?(?P<name>[A-Za-z_$][\w$]*)[\"']?\s*:")),
    ]
    found = [_member(text, masked, pairs, body[0], m, kind) for kind, p in rules for m in p.finditer(flat) if m.group("name") not in _CONTROL]
    return sorted(_flat(found, set()), key=lambda s: s.start)


def python(text: str) -> tuple[list[Symbol], bool]:
    """Classes and functions by the language's own parser."""
    tree = ast.parse(text)
    lines = text.split("\n")
    callables = (ast.FunctionDef, ast.AsyncFunctionDef)

    def symbol(node: ast.AST, kind: str) -> Symbol:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        one = Symbol(kind, node.name, first, node.end_lineno, node.lineno, first_lines("\n".join(lines[first - 1 : node.end_lineno])), ", ".join("@" + ast.unparse(d) for d in node.decorator_list))
        if isinstance(node, callables):
            called = (n.func for n in ast.walk(node) if isinstance(n, ast.Call))
            names = (f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "" for f in called)
            one.calls = [n for n in dict.fromkeys(names) if n and n != node.name]
        return one

    out = []
    for node in tree.body:
        if isinstance(node, callables):
            out.append(symbol(node, "function"))
        elif isinstance(node, ast.ClassDef):
            one = symbol(node, "class")
            for inner in node.body:
                if isinstance(inner, callables):
                    decorated = any(isinstance(d, ast.Name) and d.id == "property" for d in inner.decorator_list)
                    one.members.append(symbol(inner, "property" if decorated else "method"))
                elif isinstance(inner, ast.ClassDef):
                    one.members.append(symbol(inner, "class"))
            out.append(one)
    return out, False


def python_lines(text: str) -> list[Symbol]:
    """Classes and functions by indentation, for text that does not parse."""
    lines = text.split("\n")
    heads = [(k, len(m.group(1).expandtabs()), m.group(2), m.group(3)) for k, line in enumerate(lines) if (m := re.match(r"([ \t]*)(?:async\s+)?(class|def)\s+(\w+)", line))]
    masked = mask(text, ("#",), None).split("\n")
    top: list[Symbol] = []
    stack: list[tuple[int, Symbol]] = []
    for k, indent, word, name in heads:
        end = next((j for j in range(k + 1, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent and not lines[j].lstrip().startswith((")", "]", "}"))), len(lines))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        holder = stack[-1][1] if stack else None
        if holder is not None and holder.kind != "class":
            continue
        one = Symbol("class" if word == "class" else "method" if holder else "function", name, k, end, k + 1, first_lines("\n".join(lines[k:end])))
        if word == "def":
            one.calls = [c for c in call_names("\n".join(masked[k:end])) if c != name and c not in _CONTROL]
        (holder.members if holder else top).append(one)
        stack.append((indent, one))
    return top


def objc(text: str) -> list[Symbol]:
    masked = mask(text)
    pairs, _ = brackets(masked)
    out = []
    for m in re.finditer(r"(?ms)^@implementation\s+(\w+)(.*?)^@end", masked):
        one = Symbol("class", m.group(1), m.start(), m.end(), line_of(text, m.start()), first_lines(text[m.start() : m.end()]))
        for k in re.finditer(r"(?m)^[ \t]*[-+]\s*\([^)]*\)\s*(?P<name>\w+)[^;{]*(?=\{)", m.group(2)):
            one.members.append(_member(text, masked, pairs, m.start(2), k, "method"))
            one.members[-1].calls = []
        out.append(one)
    holes = re.sub(r"(?ms)^@implementation.*?^@end", lambda m: re.sub(r"[^\n]", " ", m.group(0)), masked)
    for k in re.finditer(r"(?m)^(?!@|#|-|\+)(?:static\s+|inline\s+)*[A-Za-z_][\w *]*?[\s*]+(?P<name>\w+)\s*(?=\([^;{}]*\)\s*\{)", holes):
        if k.group("name") not in _CONTROL:
            out.append(_member(text, masked, pairs, 0, k, "function"))
            out[-1].calls = []
    return out


def css(text: str) -> list[Symbol]:
    masked = mask(text, (), ("/*", "*/"))
    out = []
    for m in re.finditer(r"\.(-?[A-Za-z_][\w-]*)(?=[^{}]*\{)|(--[A-Za-z_][\w-]*)(?=\s*:)", masked):
        name = m.group(1) or m.group(2)
        line = masked.rfind("\n", 0, m.start()) + 1
        head = text[line : _line_stop(text, line)].strip()
        out.append(Symbol("class" if m.group(1) else "custom-property", name, m.start(), m.end(), line_of(text, m.start()), head[:100]))
    return out


def qml(text: str) -> list[Symbol]:
    masked = mask(text)
    pairs, _ = brackets(masked)
    members, seen = [], set()
    for kind, p in (
        ("id", r"(?m)^[ \t]*id\s*:\s*(?P<name>\w+)"),
        ("property", r"(?m)^[ \t]*(?:default\s+|readonly\s+|required\s+)*property\s+(?P<type>[\w.<>]+)\s+(?P<name>\w+)"),
        ("signal", r"(?m)^[ \t]*signal\s+(?P<name>\w+)"),
        ("function", r"(?m)^[ \t]*function\s+(?P<name>\w+)\s*(?=\()"),
        ("method", r"(?m)^[ \t]*(?P<name>on[A-Z]\w*)\s*(?=:)"),
        ("component", r"(?m)^[ \t]*component\s+(?P<name>\w+)\s*(?=:)"),
    ):
        for m in re.finditer(p, masked):
            if (kind, m.group("name")) not in seen:
                seen.add((kind, m.group("name")))
                one = _member(text, masked, pairs, 0, m, kind)
                one.detail, one.calls = (m.groupdict().get("type") or ""), []
                if kind in ("function", "component") and one.body is None:
                    one.snippet = excerpt(text, one.line)
                members.append(one)
    members.sort(key=lambda s: s.start)
    root = re.search(r"(?m)^[ \t]*(?P<name>[A-Z][\w.]*)\s*(?=\{)", masked)
    if not root:
        return members
    one = _member(text, masked, pairs, 0, root, "component")
    one.calls, one.members = [], members
    return [one]


def csharp_variables(text: str) -> list[Symbol]:
    """Variables that a line begins to declare, for text that is broken."""
    masked = mask(text)
    return [Symbol("variable", m.group(1), m.start(), m.end(), (line := line_of(text, m.start(1))), excerpt(text, line, 1)) for m in re.finditer(r"(?m)^[ \t]*var\s+([A-Za-z_]\w*)\s*=", masked)]


def anchored(snippet: str, name: str) -> str:
    """A partial construct from its own declaration on: what is left of the one before it goes."""
    lines = snippet.split("\n")
    while lines and lines[0].strip() in ("", "}", "};", "*/"):
        lines.pop(0)
    starts = tuple(f"{word} {name}" for word in ("function", "async function", "class", "const", "let", "var"))
    at = next((k for k, line in enumerate(lines) if name and line.strip().startswith(starts)), 0)
    return "\n".join(lines[at:]).strip()


def json_symbols(path: str, text: str) -> list[Symbol]:
    """Scripts of package.json, routes of OpenAPI documents."""
    name = path.rsplit("/", 1)[-1]
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    if name == "package.json":
        scripts = data.get("scripts")
        return [Symbol("script", k, 0, 0, 1, detail=v if isinstance(v, str) else "") for k, v in sorted(scripts.items())] if isinstance(scripts, dict) else []
    if "openapi" in name.lower() and isinstance(data.get("paths"), dict):
        return [Symbol("route", f"{m.upper()} {p}", 0, 0, 1) for p, item in sorted(data["paths"].items()) if isinstance(item, dict) for m in sorted(item)]
    return []
