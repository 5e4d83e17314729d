"""Files of source trees: listing, classification, limits, gates and previews. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The limits of a crawl and of a parse.
MAX_DEPTH, MAX_NODES, MAX_ENTRIES = 64, 50_000, 2_000
MAX_FILE_BYTES, MAX_SIDE_BYTES, MINIFIED_CHARS = 2 * 1024 * 1024, 512 * 1024, 16_384
PREVIEW_BYTES, PREVIEW_LINES = 256 * 1024, 40
# Directories that a crawl leaves out, and suffixes that it takes.
IGNORED_DIRS = (".git", ".build", ".swiftpm", "__pycache__", "venv", ".venv", "node_modules", "build", "dist", "deriveddata")
SUFFIXES = ("js", "jsx", "json", "ts", "tsx", "php", "html", "qml", "css", "py", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "java", "swift", "cs", "rs", "m", "mm")
# File type and language by lower-case suffix.
CPP_SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")
FILE_TYPES = {"php": "php", "html": "html", "qml": "qml", "css": "css", "tsx": "react", "jsx": "react", "ts": "script", "js": "script", "py": "python", "java": "java", "swift": "swift", "cs": "csharp", "rs": "rust", "m": "objc", "mm": "objc", "json": "json"} | dict.fromkeys(CPP_SUFFIXES, "cpp")
LANGUAGES = {"php": "php", "html": "html", "qml": "qml", "css": "css", "jsx": "jsx", "tsx": "tsx", "ts": "ts", "mts": "ts", "cts": "ts", "json": "json", "py": "python", "java": "java", "swift": "swift", "cs": "csharp", "rs": "rust", "m": "objc", "mm": "objc"} | dict.fromkeys(CPP_SUFFIXES, "cpp")


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(other))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    """The part before the last slash, '' without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix_of(path: Column) -> Column:
    """Lower-case text after the last dot of the name, '' without one."""
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]+)$", 1))


def file_type(path: Column) -> Column:
    return F.when(name_of(path) == "package.json", "package").otherwise(_lookup(FILE_TYPES, suffix_of(path), "file"))


def language(path: Column) -> Column:
    """Unknown suffixes are script, which matters for files named one by one; a crawl does not take them."""
    return _lookup(LANGUAGES, suffix_of(path), "script")


def ignored(rel_path: Column) -> Column:
    """True if a directory above the file is one that a crawl leaves out."""
    return F.exists(F.slice(F.split(rel_path, "/"), F.lit(1), F.size(F.split(rel_path, "/")) - 1), lambda d: F.lower(d).isin(*IGNORED_DIRS))


def included(path: Column) -> Column:
    return suffix_of(path).isin(*SUFFIXES)


def depth_of(rel_path: Column) -> Column:
    """Directories above the file."""
    return F.size(F.split(rel_path, "/")) - 1


def classify(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Adds name, suffix, dir, depth, file_type and language."""
    p = F.col(path)
    return files.withColumns({"name": name_of(p), "suffix": suffix_of(p), "dir": dir_of(p), "depth": depth_of(p), "file_type": file_type(p), "language": language(p)})


def crawl(files: DataFrame, path: str = "rel_path", root: str = "root", max_depth: int = MAX_DEPTH) -> DataFrame:
    """The files that a crawl takes, classified: known suffix, no ignored directory, not too deep."""
    return classify(files.where(included(F.col(path)) & ~ignored(F.col(path)) & (depth_of(F.col(path)) < max_depth)), path)


def limited(crawled: DataFrame, root: str = "root", per_dir: int = MAX_ENTRIES, per_root: int = MAX_NODES) -> DataFrame:
    """The first files of each directory and of each root, in the order of lower-case names, so cuts are the same each time.

    A directory's limit ranks within it; the root's limit needs counts by directory only, and of the one directory that
    holds the cut the ranks already made, so no root is sorted in one task.
    """
    in_dir = Window.partitionBy(root, "dir").orderBy(F.lower("name"), "name")
    ranked = crawled.withColumn("__n", F.row_number().over(in_dir)).where(F.col("__n") <= per_dir)
    sizes = ranked.groupBy(root, "dir").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select(F.col(root).alias("__r"), F.col("dir").alias("__d"), (F.sum("__size").over(Window.partitionBy(root).orderBy(F.lower("dir"), "dir")) - F.col("__size")).alias("__before"))
    joined = ranked.join(before, (F.col(root) == F.col("__r")) & (F.col("dir") == F.col("__d")))
    return joined.where(F.col("__before") + F.col("__n") <= per_root).drop("__n", "__r", "__d", "__before")


def skipped(crawled: DataFrame, root: str = "root", per_dir: int = MAX_ENTRIES) -> DataFrame:
    """root, dir, skipped: files beyond the directory limit, told apart instead of counted as files."""
    return crawled.groupBy(root, "dir").agg((F.count(F.lit(1)) - per_dir).alias("skipped")).where("skipped > 0")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """root, path, rel_path, length, content of all files below a root; `content` is read only where it is used.

    A file that is gone or broken when its content is read gives no row there; a listing, without content, has it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^" + r"(?:file:)?/*\Q" + root.strip("/") + r"\E/*", "")
    return found.select(F.lit(root).alias("root"), "path", rel.alias("rel_path"), "length", "content")


def text_of(content: Column) -> Column:
    """UTF-8 text with LF line ends."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "\r\n", "\n")


def line_stats(text: Column) -> Column:
    """Struct of longest, lines and average: lengths of the trimmed lines that are not blank."""
    lengths = F.filter(F.transform(F.split(text, "\n"), lambda x: F.length(F.trim(x))), lambda n: n > 0)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.struct(F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest"), F.size(lengths).alias("lines"), F.when(F.size(lengths) > 0, total / F.size(lengths)).otherwise(F.lit(0.0)).alias("average"))


def minified(name: Column, language: Column, text: Column) -> Column:
    """Script and style text of 16 384 characters or more that by its name or its long lines was made by a tool."""
    lower, stats = F.lower(name), line_stats(text)
    # The line lengths that decide.
    long_lines = (stats["longest"] >= 4000) | ((stats["longest"] >= 2000) & (stats["average"] >= 350)) | ((stats["lines"] <= 8) & (stats["average"] >= 1200))
    named = lower.contains(".min.") | lower.endswith("-min.js") | lower.endswith("-min.css")
    return language.isin("script", "jsx", "ts", "tsx", "css") & (F.length(text) >= MINIFIED_CHARS) & (named | long_lines)


def gate(name: Column, language: Column, length: Column, text: Column) -> Column:
    """ok, oversized, minified or unreadable."""
    return F.when(length > MAX_FILE_BYTES, "oversized").when(text.isNull(), "unreadable").when(minified(name, language, text), "minified").otherwise("ok")


def preview(text: Column, length: Column) -> Column:
    """The first 40 lines, and a mark if more was left out."""
    # The marks.
    lines = F.split(text, "\n")
    head = F.array_join(F.slice(lines, 1, PREVIEW_LINES), "\n")
    return F.when(length > PREVIEW_BYTES, F.concat(head, F.lit("\n... [preview truncated: file too large to load fully]"))).when(F.size(lines) > PREVIEW_LINES, F.concat(head, F.lit("\n..."))).otherwise(head)


def sources(files: DataFrame) -> DataFrame:
    """Files (root, path, rel_path, length, content, classified) with file_id, text and gate; oversized ones are never decoded."""
    small = files.where(F.col("length") <= MAX_FILE_BYTES).withColumn("text", text_of(F.col("content")))
    large = files.where(F.col("length") > MAX_FILE_BYTES).withColumn("text", F.lit(None).cast("string"))
    both = small.drop("content").unionByName(large.drop("content"))
    return both.withColumns({"file_id": F.md5(F.concat_ws("\u0000", "root", "rel_path")), "gate": gate(F.col("name"), F.col("language"), F.col("length"), F.col("text"))})
