"""Call relations as joins: within a file, and across files through imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CALLABLE_KINDS, SCRIPT_LANGUAGES
from .merge import with_notice

# Which kinds a name resolves to first.
PRIORITY = (
    ("function", "method", "constructor", "initializer", "hook", "component"),
    ("class", "struct", "enum", "protocol", "trait", "interface", "type"),
    ("module",),
    ("variable",),
    ("property",),
)
# Languages besides scripts whose snippets are searched for calls.
SNIPPET_LANGUAGES = ("swift", "php", "python", "java", "csharp", "rust")
# What is said of a file with more relations than were looked at.
CUT_IMPORTED = "Relationship graph truncated after scanning many imported files."
CUT_INCOMING = "Incoming relationship scan stopped after reaching the file analysis limit."
CUT_SUFFIX = "Relationship graph partial."
# Imported and importing files looked at for one file, where the caps are wanted.
MAX_IMPORTED, MAX_INCOMING = 24, 48


def kind_priority(kind: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for n in reversed(range(len(PRIORITY))):
        out = F.when(kind.isin(*PRIORITY[n]), n).otherwise(out)
    return out


def can_own_calls(kind: Column) -> Column:
    return kind.isin(*CALLABLE_KINDS)


def symbols(analyses: DataFrame) -> DataFrame:
    """One row per symbol of the analyses."""
    return analyses.select("file_id", F.col("path").alias("file_path"), "language", F.explode("symbols").alias("s")).select("file_id", "file_path", "language", "s.*")


def name_targets(symbols: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """For each scope and name the symbol that it resolves to: best priority, then first in pre-order."""
    scope = scope or ["file_id"]
    best = F.min_by("sym_id", F.struct(kind_priority(F.col("kind")), "sym_id"))
    return symbols.groupBy(*scope, "name").agg(best.alias("target_id"))


def same_file_calls(symbols: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """file_id, owner_id, target_id: distinct calls that resolve within the file, none to itself.

    calls (file_id, owner_id, name) defaults to the call names that the symbols carry. Extracted names
    and names in snippets go the same way, so their edges are one distinct set.
    """
    if calls is None:
        calls = symbols.where(can_own_calls(F.col("kind"))).select("file_id", F.col("sym_id").alias("owner_id"), F.explode("calls").alias("name"))
    return calls.join(name_targets(symbols), ["file_id", "name"]).where("owner_id <> target_id").select("file_id", "owner_id", "target_id").distinct()


def snippet_calls(symbols: DataFrame) -> DataFrame:
    """file_id, owner_id, name: call names in snippets; owners are callables, in script languages symbols of any kind."""
    from ..functions.text import call_names

    return symbols.where(owns_snippet_calls()).select("file_id", F.col("sym_id").alias("owner_id"), F.explode(call_names(F.col("snippet"))).alias("name"))


def owns_snippet_calls() -> Column:
    return F.col("language").isin(*SCRIPT_LANGUAGES) | (can_own_calls(F.col("kind")) & F.col("language").isin(*SNIPPET_LANGUAGES))


def relations(symbols: DataFrame) -> DataFrame:
    """file_id, owner_id, target_id: calls by extracted names and by names in snippets, each once.

    Both lists of a symbol are put together in its row, so its names are made distinct there.
    """
    from ..functions.text import call_names

    none = F.array().cast("array<string>")
    listed = lambda test, names: F.when(test, F.coalesce(names, none)).otherwise(none)
    names = F.array_distinct(F.concat(listed(can_own_calls(F.col("kind")), F.col("calls")), listed(owns_snippet_calls(), call_names(F.col("snippet")))))
    return same_file_calls(symbols, symbols.select("file_id", F.col("sym_id").alias("owner_id"), F.explode(names).alias("name")))


def with_reverse(edges: DataFrame) -> DataFrame:
    """file_id, symbol_id, other_id, direction: every edge from both ends."""
    calls = edges.select("file_id", F.col("owner_id").alias("symbol_id"), F.col("target_id").alias("other_id"), F.lit("calls").alias("direction"))
    back = edges.select("file_id", F.col("target_id").alias("symbol_id"), F.col("owner_id").alias("other_id"), F.lit("calledBy").alias("direction"))
    return calls.unionByName(back)


def cross_file_calls(symbols: DataFrame, dependencies: DataFrame, max_imported: int | None = None) -> DataFrame:
    """file_id, owner_id, target_file_id, target_id, name: calls of names that an imported file has.

    dependencies: file_id, ord, target_file_id, bindings. All names of the imported file count, and local
    names of bindings stand for the imported ones. Names that the owner's own file resolves are left, and of
    several files that have a name the first imported one counts. Only script languages take part.
    """
    script = symbols.where(F.col("language").isin(*SCRIPT_LANGUAGES))
    linked = dependencies.where("target_file_id IS NOT NULL AND target_file_id <> file_id")
    if max_imported is not None:
        linked = linked.withColumn("__n", F.row_number().over(Window.partitionBy("file_id").orderBy("ord"))).where(F.col("__n") <= max_imported).drop("__n")
    targets = name_targets(script).select(F.col("file_id").alias("target_file_id"), F.col("name").alias("imported"), "target_id")
    own = script.select("file_id", "name")
    calls = script.where(can_own_calls(F.col("kind"))).select("file_id", F.col("sym_id").alias("owner_id"), F.explode("calls").alias("name"))
    calls = calls.join(own, ["file_id", "name"], "left_anti")
    # names that no script has stay out; the others meet the file's imports first, so rows grow with calls and imports, not with the names of imported files
    known = script.select("name").distinct()
    plain = calls.join(known, "name", "left_semi").join(linked.select("file_id", "ord", "target_file_id"), "file_id").withColumn("imported", F.col("name"))
    bound = linked.select("file_id", "ord", "target_file_id", F.explode("bindings").alias("b")).select("file_id", "ord", "target_file_id", F.col("b.local").alias("name"), F.col("b.imported").alias("imported"))
    alias = calls.join(bound.where("name <> imported"), ["file_id", "name"]).select(*plain.columns)
    found = plain.unionByName(alias).join(targets, ["target_file_id", "imported"])
    first = found.groupBy("file_id", "owner_id", "name").agg(F.min(F.struct("ord", "target_file_id", "target_id")).alias("t"))
    return first.select("file_id", "owner_id", F.col("t.target_file_id").alias("target_file_id"), F.col("t.target_id").alias("target_id"), "name")


def incoming_calls(edges: DataFrame, max_incoming: int | None = None) -> DataFrame:
    """The cross-file edges seen from the called side; at most so many calling files, in order, where a cap is wanted."""
    back = edges.select(F.col("target_file_id").alias("file_id"), F.col("target_id").alias("symbol_id"), F.col("file_id").alias("caller_file_id"), F.col("owner_id").alias("caller_id"))
    if max_incoming is None:
        return back
    files = back.select("file_id", "caller_file_id").distinct()
    kept = files.withColumn("__n", F.row_number().over(Window.partitionBy("file_id").orderBy("caller_file_id"))).where(F.col("__n") <= max_incoming).drop("__n")
    return back.join(kept, ["file_id", "caller_file_id"], "left_semi")


def worth_incoming(symbols: DataFrame) -> DataFrame:
    """Files with a callable, a type or a module: the only ones whose callers are looked for."""
    kinds = [k for some in PRIORITY[:3] for k in some]
    return symbols.where(F.col("kind").isin(*kinds)).select("file_id").distinct()


def noticed(analyses: DataFrame, dependencies: DataFrame, edges: DataFrame, max_imported: int | None, max_incoming: int | None) -> DataFrame:
    """The analyses, with a notice and a summary that says so where a cap has cut imported or calling files.

    edges: cross-file calls before max_incoming is applied.
    """
    over = lambda rows, file, other, most: rows.select(F.col(file).alias("file_id"), F.col(other).alias("other")).distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    cuts = []
    if max_imported is not None:
        linked = dependencies.where("target_file_id IS NOT NULL AND target_file_id <> file_id")
        cuts.append((CUT_IMPORTED, over(linked, "file_id", "ord", max_imported)))
    if max_incoming is not None:
        cuts.append((CUT_INCOMING, over(edges, "target_file_id", "file_id", max_incoming)))
    out = analyses
    for message, files in cuts:
        cut = F.col("__n").isNotNull()
        suffixed = F.when(F.col("summary").endswith(CUT_SUFFIX), F.col("summary")).otherwise(F.concat_ws(" ", "summary", F.lit(CUT_SUFFIX)))
        out = out.join(files, "file_id", "left").withColumns(
            {"notices": F.when(cut, with_notice(F.col("notices"), "warning", message)).otherwise(F.col("notices")), "partial": F.col("partial") | cut, "summary": F.when(cut, suffixed).otherwise(F.col("summary"))}
        ).drop("__n")
    return out.select(*analyses.columns)


def paths_of_names(symbols: DataFrame) -> DataFrame:
    """file_id, sym_id, depth, path: names from the top down to each symbol, joined one level of the tree after another."""
    levels = symbols.agg(F.max("depth")).first()[0] or 0
    known = symbols.where("depth = 0").select("file_id", "sym_id", "depth", F.col("name").alias("path"))
    out = known
    for level in range(1, levels + 1):
        above = known.select("file_id", F.col("sym_id").alias("parent_id"), F.col("path").alias("above"))
        known = symbols.where(F.col("depth") == level).join(above, ["file_id", "parent_id"]).select("file_id", "sym_id", "depth", F.concat_ws(".", "above", "name").alias("path"))
        out = out.unionByName(known)
    return out
