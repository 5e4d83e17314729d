"""Scalar functions on source text as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARK = "\u0001"


def located(df: DataFrame, key: list[str], text: str, pattern: str, group: int = 1) -> DataFrame:
    """One row per match: the key, ord (from 0), line (from 1), capture.

    The text is cut before every match; the lines before a cut are a running sum over the pieces of one text.
    """
    clean = F.replace(F.col(text), F.lit(MARK), F.lit(""))
    pieces = df.select(*key, F.posexplode(F.split(F.regexp_replace(clean, f"({pattern})", MARK + "$1"), MARK)).alias("pos", "piece"))
    earlier = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    lead = F.regexp_extract(F.col("piece"), r"^(\s*)", 1)
    own = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
    rows = pieces.withColumn("line", (F.coalesce(F.sum(breaks).over(earlier), F.lit(0)) + own + 1).cast("int"))
    return rows.where("pos > 0").select(*key, (F.col("pos") - 1).alias("ord"), "line", F.regexp_extract("piece", pattern, group).alias("capture"))


def excerpt(text: Column, line: Column, context: int = 0, limit: int = 220) -> Column:
    """Lines around a line, trimmed; cut at the limit with a mark."""
    lines = F.split(text, "\n")
    first = F.greatest(line - context, F.lit(1))
    found = F.trim(F.array_join(F.slice(lines, first, F.greatest(line + context - first + 1, F.lit(0))), "\n"))
    return F.when(F.length(found) <= limit, found).otherwise(F.concat(F.trim(F.substring(found, 1, limit)), F.lit(" ...")))


def first_lines(text: Column, limit: int = 10) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > limit, F.concat(F.array_join(F.slice(lines, 1, limit), "\n"), F.lit("\n..."))).otherwise(text)


def first_identifier(text: Column) -> Column:
    return F.regexp_extract(text, r"([A-Za-z_]\w*)", 1)


def variable_name(text: Column) -> Column:
    return F.regexp_extract(text, r"(\$[A-Za-z_]\w*)", 1)


def last_identifier(text: Column) -> Column:
    return F.regexp_extract(text, r"([A-Za-z_]\w*)\s*$", 1)


def unquoted(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"""^["'`]?(.*?)["'`]?$""", 1)


def call_names(snippet: Column) -> Column:
    """Distinct identifiers that stand before a bracket, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(snippet, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))


def import_bindings(clause: Column) -> Column:
    """Array of (local, imported) of a braced clause: `a as b` and `a: b` bind b to a."""
    parts = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: F.split(x, r"\s+as\s+|\s*:\s*")
    return F.transform(parts, lambda x: F.struct(F.element_at(words(x), -1).alias("local"), F.element_at(words(x), 1).alias("imported")))


def rust_label(path: Column) -> Column:
    """First segment of a use path, or the name it is given."""
    return F.when(path.rlike(r"\s+as\s+\w+\s*$") & ~path.contains("{"), F.regexp_extract(path, r"\s+as\s+(\w+)\s*$", 1)).otherwise(F.regexp_extract(F.trim(path), r"^(?:::)?(\w+)", 1))


def signature_head(snippet: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(F.trim(snippet), "{", 1), "\n", 1))


def byte_size(n: Column) -> Column:
    """B, KB, MB or GB by 1024; one decimal below 10, none for bytes; halves go to the even digit."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), unit + 1)
    return F.when((unit > 0) & (value < 10), F.format_string("%.1f %s", F.bround(value, 1), name)).otherwise(F.format_string("%.0f %s", F.bround(value, 0), name))


def truncation(snippet: Column) -> Column:
    """Struct of truncated, code and marker: what a shortened snippet ends with."""
    # The marks of shortened snippets, in the order they are looked for.
    marker = F.when(snippet.rlike(r"\n\.\.\.\s*$"), "\n...").when(snippet.rlike(r"\{ \.\.\. \}\s*$"), "{ ... }").when(snippet.rlike(r" \.\.\.\s*$"), " ...").otherwise("")
    code = F.regexp_replace(snippet, r"(?:\n\.\.\.|\{ \.\.\. \}| \.\.\.)\s*$", "")
    return F.struct((marker != "").alias("truncated"), code.alias("code"), marker.alias("marker"))


def snippet_language(language: Column) -> Column:
    """The language that a snippet is coloured and checked as; '' for Swift and unknown ones."""
    known = ("php", "html", "qml", "css", "jsx", "tsx", "ts", "json", "python", "cpp", "java", "csharp", "rust", "objc")
    return F.when(language == "script", "js").when(language.isin(*known), language).otherwise("")


def relative_path(path: Column, root: Column) -> Column:
    below = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(path == root, F.lit("/")).when(below, F.substr(path, F.length(root) + 2)).otherwise(path)


def normalized(path: Column) -> Column:
    """A relative path without `.` and `..` segments; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(acc.isNull(), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def target_path(source: Column, path: Column, fallback: Column) -> Column:
    """Where a symbol is found: the file it came from, else its own path, else the file at hand."""
    known = lambda c: F.when(c != "", c)
    return F.coalesce(known(source), known(path), fallback)
