"""A session over a project: selections, snippets and JSON commands, answered from its tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncation
from ..sources.tree import preview
from .project import Project, open_tree


class Session:
    """The state that a command line keeps: a root, a selected file, a selected symbol and expanded directories.

    Each selection is a filter on a table by a key; only the rows of the selected file come to the driver.
    """

    def __init__(self, spark: SparkSession, project: Project | None = None):
        self.spark, self.project = spark, project
        self.root, self.path, self.symbol = "", "", None
        self.expanded: set[str] = set()

    # commands

    def set_root_path(self, path: str) -> None:
        self.__init__(self.spark, open_tree(self.spark, path))
        self.root = path

    def select_path(self, rel_path: str) -> None:
        self.path, self.symbol = rel_path, None

    def select_symbol(self, index: int) -> None:
        """The index-th top-level symbol; out of range selects none."""
        rows = self._symbols().where((F.col("depth") == 0) & (F.col("ord") == index)).limit(1).collect()
        self.symbol = rows[0].asDict(recursive=True) if rows else None

    def select_symbol_by_data(self, name: str, kind: str, line: int, path: str = "") -> None:
        """The first symbol in pre-order with that name, kind and line; what was given stays if there is none."""
        if path and path != self.path:
            self.select_path(path)
        found = self._symbols().where((F.col("name") == name) & (F.col("kind") == kind) & (F.col("line") == line)).orderBy("sym_id").limit(1).collect()
        self.symbol = found[0].asDict(recursive=True) if found else {"name": name, "kind": kind, "line": line}

    def toggle_expanded(self, directory: str) -> None:
        self.expanded ^= {directory}

    # tables

    def _file(self) -> DataFrame:
        return self.project.files.where(F.col("rel_path") == self.path)

    def _symbols(self) -> DataFrame:
        return self.project.symbols.join(self._file().select("file_id"), "file_id", "left_semi")

    def visible_entries(self) -> DataFrame:
        """Files and directories all of whose parents are expanded: directories first, by lower-case path."""
        files = self.project.files
        parts = F.split("rel_path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        entries = files.select(F.explode(above).alias("path"), "rel_path").select("path", (F.col("path") != F.col("rel_path")).alias("is_dir")).distinct()
        own = F.split("path", "/")
        parents = F.transform(F.sequence(F.lit(1), F.size(own)), lambda n: F.array_join(F.slice(own, F.lit(1), n - 1), "/"))
        opened = F.array(*[F.lit(x) for x in ("", *sorted(self.expanded))])
        return entries.where(F.forall(parents, lambda p: F.array_contains(opened, p))).select("path", "is_dir", (F.size(own) - 1).alias("depth")).orderBy(F.lower("path"))

    def snippet(self) -> dict:
        """The selected symbol's snippet, or the file's preview."""
        if self.symbol and self.symbol.get("snippet"):
            row = self.spark.range(1).select(truncation(F.lit(self.symbol["snippet"])).alias("t")).first()["t"]
            return {"kind": self.symbol["kind"], "name": self.symbol["name"], "line": self.symbol["line"], "snippet": self.symbol["snippet"], "isTruncated": row["truncated"]}
        row = self._file().select(preview(F.col("text"), F.col("length")).alias("p")).first()
        return {"kind": "file", "name": self.path.rsplit("/", 1)[-1], "line": 0, "snippet": row["p"] if row else "", "isTruncated": bool(row and row["p"] and "\n..." in row["p"])}

    def project_summary(self) -> dict:
        row = self.project.summary.first()
        return row.asDict(recursive=True) if row else {}

    def state(self) -> dict:
        analysis = self.project.analyses.join(self._file().select("file_id"), "file_id", "left_semi").first() if self.path else None
        return {
            "rootPath": self.root, "projectSummary": self.project_summary(), "selectedRelativePath": self.path, "selectedFileData": analysis.asDict(recursive=True) if analysis else {},
            "selectedSymbol": self.symbol or {}, "selectedSnippet": self.snippet() if self.path else {}, "fileSystem": [r.asDict() for r in self.visible_entries().collect()],
        }

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        """Answers JSON commands, one per line, with one compact JSON object each; lines that are no command are passed over."""
        for line in lines:
            try:
                command = json.loads(line)
                name, given = command["command"], command.get("params") or {}
            except (ValueError, TypeError, KeyError):
                continue
            if name == "exit":
                return
            calls = {
                "setRootPath": lambda p: self.set_root_path(p["path"]), "selectPath": lambda p: self.select_path(p["path"]), "selectSymbol": lambda p: self.select_symbol(p["index"]),
                "selectSymbolByData": lambda p: self.select_symbol_by_data(p["name"], p["kind"], p["line"], p.get("path", "")), "toggleExpanded": lambda p: self.toggle_expanded(p["path"]),
            }
            if name in calls:
                calls[name](given)
            yield json.dumps(self.project_summary() if name == "getProjectSummary" else self.state(), separators=(",", ":"), default=str)


def documents(project: Project) -> DataFrame:
    """The analyses with all that belongs to a file: resolved dependencies, relations, related files, quick links, classes.

    Each list is made of the project's table by the file's id; files without entries get empty lists.
    """
    names = project.symbols.select("file_id", F.col("sym_id").alias("other_id"), "kind", "name", "line")
    relations = project.relations.join(names, ["file_id", "other_id"])
    usage = project.css_usage.unionByName(project.style_usage.select("root", "file_id", "class", "role", F.col("page").alias("src_path")))
    lists = {
        "dependencies": (project.dependencies, ["ord", "type", "target", "label", "line", "snippet", "target_path", "exists", "bindings"]), "relations": (relations, ["symbol_id", "direction", "kind", "name", "line", "other_id"]),
        "relatedFiles": (project.related, ["path", "type"]), "quickLinks": (project.quick_links, ["ord", "type", "target", "line", "rel_path", "exists"]), "cssSummary": (usage, ["class", "role", "src_path"]),
    }
    out = project.analyses.drop("dependencies")
    for name, (rows, columns) in lists.items():
        listed = rows.groupBy("file_id").agg(F.collect_list(F.struct(*columns)).alias(name))
        listed = listed.select("file_id", F.array_sort(name, _by(columns)).alias(name))
        kind = listed.schema[name].dataType
        out = out.join(listed, "file_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def _by(columns: list[str]):
    """Orders structs by their plain columns (a list of structs inside has no order that matters)."""
    def compare(a, b):
        out = F.lit(0)
        for c in reversed([c for c in columns if c != "bindings"]):
            x, y = F.coalesce(a[c].cast("string"), F.lit("")), F.coalesce(b[c].cast("string"), F.lit(""))
            x, y = (a[c], b[c]) if c in ("ord", "symbol_id", "line", "other_id") else (x, y)
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return compare


def analyses_json(analyses: DataFrame) -> DataFrame:
    """One compact JSON text per file, to be written as text by any number of tasks."""
    return analyses.select("path", F.to_json(F.struct(*analyses.columns)).alias("value"))
