"""One file's text to its analysis document, and the Arrow step that does so for a table of files."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ...functions.scan import signature
from ...functions.text import byte_size
from ...schemas import ANALYSIS
from ...sources.tree import MAX_FILE_BYTES
from ..merge import merge_symbols
from . import languages as L
from . import side
from .outline import Symbol, outline

GRAMMARS = {"java": L.JAVA, "csharp": L.CSHARP, "rust": L.RUST, "php": L.PHP, "swift": L.SWIFT}
#: Languages whose symbols come from patterns alone, and whose call names give no relations.
HEURISTIC = ("script", "jsx", "html", "qml", "json", "cpp", "objc")
RECOVERED = "Heuristic recovery supplemented partial AST analysis."
#: Notices of files that are not parsed, by gate.
GATE_NOTICES = {
    "oversized": ("warning", "Analysis skipped: file is too large"),
    "minified": ("info", "Analysis skipped: file looks minified"),
    "unreadable": ("error", "Unable to read file"),
}


def parse(path: str, text: str, language: str) -> tuple[list[Symbol], str, bool]:
    """Symbols, source mode and whether the structure is broken."""
    if language == "python":
        try:
            return *L.python(text)[:1], "ast", False
        except (SyntaxError, ValueError, RecursionError):
            return L.python_lines(text), "recovered", True
    if language in ("ts", "tsx"):
        symbols, broken = L.script(text, language)
        if broken:
            found = merge_symbols(symbols, L.script(text, language, lenient=True)[0])
            for s in found:
                s.snippet = L.anchored(s.snippet, s.name)
            return found, "recovered", True
        return symbols, "ast", False
    if language in GRAMMARS:
        symbols, broken = outline(text, GRAMMARS[language])
        if broken and language != "swift":
            lenient = outline(text, GRAMMARS[language], lenient=True)[0]
            return merge_symbols(symbols, lenient + (L.csharp_variables(text) if language == "csharp" else [])), "recovered", True
        return symbols, "ast", broken
    if language in ("script", "jsx"):
        return L.script(text, language)[0], "heuristic", False
    if language == "cpp":
        found = outline(text, L.CPP)[0]
        flat = [s for top in found for s in (top, *top.members)]
        for s in flat:
            s.members, s.calls, s.kind = [], [], "class" if s.kind == "class" else "function"
        return flat, "heuristic", False
    if language == "css":
        return L.css(text), "ast", False
    found = {"objc": L.objc, "qml": L.qml}.get(language)
    if found:
        return found(text), "heuristic", False
    return (L.json_symbols(path, text) if language == "json" else []), "heuristic", False


def _rows(symbols: list[Symbol], language: str, mode: str, confidence: str) -> list[dict]:
    out: list[dict] = []

    def add(items: list[Symbol], parent: int | None, depth: int) -> None:
        for n, s in enumerate(items):
            parameters, returns = signature(s.snippet, s.kind, s.name, language)
            number = len(out)
            member = depth > 0 and language in ("php", "java", "csharp", "rust", "objc", "cpp") and s.kind in ("method", "constructor", "property", "field", "constant", "variant")
            line_only = language == "css"
            out.append(
                {"sym_id": number, "parent_id": parent, "depth": depth, "ord": n, "kind": s.kind, "name": s.name, "line": s.line, "detail": s.detail, "snippet": s.snippet,
                 "snippet_kind": "line_excerpt" if line_only else "exact_construct" if s.snippet else "file_preview", "diagnostics_mode": "none" if member or line_only or not s.snippet or (mode == "recovered" and language in ("ts", "tsx")) else "parse_snippet",
                 "source_mode": s.source_mode or mode, "confidence": confidence, "parameters": parameters, "returns": returns, "calls": s.calls}
            )
            add(s.members, number, depth + 1)

    add(symbols, None, 0)
    return out


def analyse(file_id: str, path: str, text: str | None, language: str, gate: str = "ok") -> dict:
    """The analysis document of a file. A null text is an unreadable file; a parser's failure is a notice, not an error."""
    empty = {"file_id": file_id, "path": path, "language": language, "source_mode": "heuristic", "confidence": "low", "has_ast_errors": False, "partial": False, "symbols": [], "dependencies": [], "routes": [], "notices": [], "package": None}
    if text is None or gate != "ok":
        gate, _, sizes = gate.partition(" ")
        severity, message = GATE_NOTICES[gate if gate != "ok" else "unreadable"]
        message += f" ({sizes})" if sizes else ""
        return empty | {"partial": True, "summary": message, "notices": [{"severity": severity, "message": message}]}
    text = text.replace("\r\n", "\n")
    try:
        symbols, mode, broken = parse(path, text, language)
        # provenance by mode and errors
        confidence = "medium" if mode != "ast" or broken else "high"
        number = lambda rows: [r | {"ord": k} for k, r in enumerate(rows)]
        return empty | {
            "source_mode": mode, "confidence": confidence, "has_ast_errors": broken, "partial": mode == "recovered", "summary": f"{len(symbols)} top-level symbols",
            "symbols": _rows(symbols, language, mode, confidence), "dependencies": number(side.dependencies(text, language)), "routes": number(side.routes(text, language)),
            "package": side.package(path, text), "notices": [{"severity": "warning", "message": RECOVERED}] if mode == "recovered" else [],
        }
    except Exception as problem:  # one file never fails a task; its notice says so
        return empty | {"partial": True, "summary": "Analysis failed", "notices": [{"severity": "error", "message": f"Analysis failed: {type(problem).__name__}"}]}


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Rows of nested lists and dicts as columns; every list of dicts is flattened, so Arrow converts plain columns only."""
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        offsets = list(accumulate((len(v) for v in values), initial=0))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _array(list(chain.from_iterable(values)), kind.value_type), type=kind)
    if pa.types.is_struct(kind) and None not in values:
        fields = [kind.field(k) for k in range(kind.num_fields)]
        return pa.StructArray.from_arrays([_array([v[f.name] for v in values], f.type) for f in fields], fields=fields)
    return pa.array(values, kind)


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns after the first five stand behind the analysis as they are."""
    schema = to_arrow_schema(ANALYSIS)
    collecting = gc.isenabled()
    gc.disable()  # a batch makes many objects and no cycles
    try:
        for batch in batches:
            rows = [analyse(*values) for values in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)]
            arrays = [_array([r[f.name] for r in rows], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[5:]], names=[*schema.names, *batch.schema.names[5:]])
    finally:
        if collecting:
            gc.enable()


def extract(files: DataFrame, keep: str = "") -> DataFrame:
    """Analyses (schemas.ANALYSIS) of files with file_id, path, text, language and perhaps gate; a row in, a row out, no shuffle.

    keep: a prefix under which the columns of the files come along.
    """
    gate = F.coalesce("gate", F.lit("ok")) if "gate" in files.columns else F.lit("ok")
    text = F.when(gate == "ok", F.col("text"))
    if "length" in files.columns:  # the notice of an oversized file tells its size
        sizes = F.concat(F.lit("oversized "), byte_size(F.col("length")), F.lit(", limit "), byte_size(F.lit(MAX_FILE_BYTES)))
        gate = F.when(gate == "oversized", sizes).otherwise(gate)
    kept = [F.col(c).alias(keep + c) for c in files.columns] if keep else []
    read = files.select("file_id", "path", text.alias("text"), F.coalesce("language", F.lit("script")).alias("language"), gate.alias("gate"), *kept)
    return read.mapInArrow(_analyse, T.StructType([*ANALYSIS.fields, *read.schema.fields[5:]]))
