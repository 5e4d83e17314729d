"""What files name in each other: dependency targets, related files, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, rust_label
from ..sources.tree import name_of
from .merge import provenance

# What is tried, in order, for a relative target of an import.
CANDIDATES = ("", ".js", ".json", ".ts", ".tsx", ".py", ".php", ".java", ".cs", ".cpp", ".hpp", "/index.js", "/index.ts", "/index.tsx", "/__init__.py")
# The same for imports that a parser of scripts finds.
SHORT_CANDIDATES = ("", ".js", ".json", ".ts", ".tsx", "/index.js", "/index.ts")
# Where the file of a Rust module may be, in order.
MODULE_CANDIDATES = (".rs", "/mod.rs")
# Languages whose imports name no files.
NAMED_ONLY = ("python", "java", "csharp")
# Related files by (pattern of the own name, candidate relative to the own directory, type); {b} is the
# name without its last suffix, {d} the directory's name, {t} the name without .test or .spec.
RELATED = (
    (r"\.(test|spec)\.", "../{t}", "implementation"),
    (r"^(?!.*\.(test|spec)\.)", "tests/{b}.test.js", "test"),
    (r"^(?!.*\.(test|spec)\.)", "tests/{b}.spec.js", "test"),
    (r"^(?!.*\.(test|spec)\.)", "tests/{b}.test.ts", "test"),
    (r"^(?!.*\.(test|spec)\.)", "tests/{b}.spec.ts", "test"),
    (r"^(?!.*\.(test|spec)\.)", "../tests/{b}.test.js", "test"),
    (r"^(?!.*\.(test|spec)\.)", "../tests/{b}.spec.js", "test"),
    (r"^index\.(js|ts)$", "package.json", "package"),
    (r"^index\.(js|ts)$", "public_html/index.html", "frontend"),
    (r"\.(cpp|cc|cxx)$", "{b}.h", "header"),
    (r"\.(cpp|cc|cxx)$", "{b}.hpp", "header"),
    (r"\.(h|hpp|hh|hxx)$", "{b}.cpp", "implementation"),
    (r"\.(h|hpp|hh|hxx)$", "{b}.cc", "implementation"),
    (r"\.(h|hpp|hh|hxx)$", "{b}.cxx", "implementation"),
    (r"\.py$", "test_{b}.py", "test"),
    (r"\.py$", "{b}_test.py", "test"),
    (r"\.py$", "tests/test_{b}.py", "test"),
    (r"\.cs$", "{d}.csproj", "project"),
    (r"\.mm?$", "{b}.h", "header"),
    (r"\.rs$", "mod.rs", "module"),
    (r"\.rs$", "lib.rs", "crate"),
    (r"\.rs$", "main.rs", "entrypoint"),
    (r"^package\.json$", "index.js", "entrypoint"),
    (r"^package\.json$", "index.ts", "entrypoint"),
)


def joined(directory: Column, target: Column) -> Column:
    return normalized(F.concat_ws("/", directory, target))


def dependency_rows(analyses: DataFrame, also: list[str] | None = None) -> DataFrame:
    """file_id, path, language, the fields of each dependency, where it comes from (source_mode, confidence), and what else is asked for."""
    origin = ["file_id", "path", "language", "source_mode", provenance(F.col("source_mode"), F.col("has_ast_errors")).alias("confidence")]
    also = also or []
    return analyses.select(*origin, *also, F.explode("dependencies").alias("d")).select("file_id", "path", "language", "d.*", "source_mode", "confidence", *also)


def resolve(dependencies: DataFrame, files: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """Adds target_file_id, target_path, exists and label: the first candidate of a target that is a file of the root.

    dependencies: root, file_id, dir, language, ord, type, target and more; files: root, rel_path, file_id. Scripts try
    the candidates of relative targets; includes are looked for relative to the own directory, and Rust modules as files
    beside it. Imports of modules and packages name no file and count as existing; so do includes without a directory.
    A join per candidate position is one join on the exploded candidates. What many files of a directory name is tried
    once; a target's path is normalized once, and the ends of the candidates are put to it.
    """
    target, language = F.col("target"), F.col("language")
    include, module = language.isin("cpp", "objc"), (language == "rust") & (F.col("type") == "module")
    script = ~language.isin("rust", *NAMED_ONLY) & target.rlike(r"^\.{0,2}/")
    what = ["root", "dir", "language", "type", "target"]
    # only a target that ends in a name keeps its path when something is put to it
    named, path = ~target.rlike(r"(^|/)\.{0,2}$"), joined(F.col("dir"), target)
    several = lambda ends: F.when(named, F.transform(F.array(*[F.lit(c) for c in ends]), lambda end: F.concat(F.col("__path"), end))).otherwise(F.array(*[joined(F.col("dir"), F.concat(target, F.lit(c))) for c in ends]))
    tries = F.when(include, F.array("__path")).when(module, several(MODULE_CANDIDATES)).when(script, several(candidates))
    asked = dependencies.where(include | module | script).select(*what).distinct().withColumn("__path", F.when(named | include, path))
    tried = asked.select(*what, F.posexplode(tries).alias("pos", "rel_path")).where("rel_path IS NOT NULL")
    known = files.select("root", "rel_path", F.col("file_id").alias("target_file_id"))
    first = tried.join(known, ["root", "rel_path"]).groupBy(*what).agg(F.min_by(F.struct("target_file_id", "rel_path"), "pos").alias("t"))
    out = dependencies.join(first, what, "left")
    exists = F.col("t").isNotNull() | language.isin(*NAMED_ONLY) | ((language == "rust") & ~module) | (include & ~target.contains("/"))
    label = F.when((language == "rust") & ~module, rust_label(target)).when(F.col("t").isNotNull() & ~include, name_of(F.col("t.rel_path"))).otherwise(target)
    return out.select(*dependencies.columns, F.col("t.target_file_id").alias("target_file_id"), F.col("t.rel_path").alias("target_path"), exists.alias("exists"), label.alias("label"))


def related(files: DataFrame) -> DataFrame:
    """root, file_id, path, type: files that a rule names and that exist; each once, by its first rule, never the file itself."""
    name, base = F.col("name"), F.regexp_replace("name", r"\.[^.]*$", "")
    last_dir = F.element_at(F.split("dir", "/"), -1)
    plain = F.regexp_replace("name", r"\.(test|spec)(?=\.)", "")
    rules = []
    for n, (pattern, candidate, kind) in enumerate(RELATED):
        made = F.replace(F.replace(F.replace(F.lit(candidate), F.lit("{b}"), base), F.lit("{d}"), last_dir), F.lit("{t}"), plain)
        rules.append(F.when(name.rlike(pattern), F.struct(F.lit(n).alias("rule"), made.alias("candidate"), F.lit(kind).alias("type"))))
    tried = files.select("root", "file_id", "dir", F.col("rel_path").alias("own"), F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"))
    tried = tried.withColumn("rel_path", joined(F.col("dir"), F.col("r.candidate"))).where("rel_path IS NOT NULL AND rel_path <> own")
    first = tried.groupBy("root", "file_id", "rel_path").agg(F.min_by("r.type", "r.rule").alias("type"))
    return first.join(files.select("root", "rel_path"), ["root", "rel_path"], "left_semi").select("root", "file_id", F.col("rel_path").alias("path"), "type")


def packages(files: DataFrame) -> DataFrame:
    """root, rel_path and the facts of each package.json (a column text): built-in JSON functions only."""
    shape = "name string, version string, main string, browser string, module string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"
    read = files.where("name = 'package.json'").withColumn("p", F.from_json("text", shape))
    section = lambda c: F.transform(F.array_sort(F.map_entries(F.coalesce(F.col(f"p.{c}"), F.create_map().cast("map<string,string>")))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(c).alias("section")))
    deps = F.concat(section("dependencies"), section("devDependencies"))
    return read.select("root", "rel_path", "p.name", "p.version", "p.main", "p.browser", "p.module", "p.scripts", deps.alias("deps"), F.size(deps).alias("dep_count"))
