"""Fixed schemas of the tables that an analysis gives, and the enumerations in them."""

from __future__ import annotations

from pyspark.sql import types as T

# The enumerations of the document model.
LANGUAGES = ("php", "swift", "html", "qml", "css", "script", "jsx", "tsx", "ts", "json", "python", "cpp", "java", "csharp", "rust", "objc", "folder", "")
FILE_TYPES = ("folder", "php", "html", "qml", "css", "react", "script", "python", "cpp", "java", "swift", "csharp", "rust", "objc", "package", "json", "file")
SNIPPET_KINDS = ("file_preview", "exact_construct", "block_excerpt", "line_excerpt", "context_excerpt")
DIAGNOSTICS_MODES = ("parse_snippet", "none")
SOURCE_MODES = ("ast", "heuristic", "recovered")
CONFIDENCES = ("high", "medium", "low")
SEVERITIES = ("info", "warning", "error")
GATES = ("ok", "oversized", "minified", "unreadable")
SCRIPT_LANGUAGES = ("script", "jsx", "ts", "tsx")
CALLABLE_KINDS = ("function", "method", "constructor", "initializer", "deinitializer", "hook", "component")
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "function", "return", "else", "do", "try")

STRING, INT, BOOL = T.StringType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PARAMETER = struct(name=STRING, type=STRING)
SYMBOL = struct(
    sym_id=INT, parent_id=INT, depth=INT, ord=INT, kind=STRING, name=STRING, line=INT, detail=STRING, snippet=STRING, snippet_kind=STRING, diagnostics_mode=STRING,
    source_mode=STRING, confidence=STRING, parameters=T.ArrayType(PARAMETER), returns=T.ArrayType(STRING), calls=T.ArrayType(STRING),
)
BINDING = struct(local=STRING, imported=STRING)
DEPENDENCY = struct(ord=INT, type=STRING, target=STRING, line=INT, snippet=STRING, bindings=T.ArrayType(BINDING))
ROUTE = struct(ord=INT, owner=STRING, method=STRING, path=STRING, label=STRING, line=INT, snippet=STRING)
NOTICE = struct(severity=STRING, message=STRING)
REQUIREMENT = struct(name=STRING, version=STRING, section=STRING)
PACKAGE = struct(name=STRING, version=STRING, main=STRING, scripts=T.MapType(STRING, STRING), dependencies=T.ArrayType(REQUIREMENT), dependency_count=INT)
#: One row per file.
ANALYSIS = struct(
    file_id=STRING, path=STRING, language=STRING, summary=STRING, source_mode=STRING, confidence=STRING, has_ast_errors=BOOL, partial=BOOL,
    symbols=T.ArrayType(SYMBOL), dependencies=T.ArrayType(DEPENDENCY), routes=T.ArrayType(ROUTE), notices=T.ArrayType(NOTICE), package=PACKAGE,
)
