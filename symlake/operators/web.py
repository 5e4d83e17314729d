"""Web assets: links between pages, styles and scripts, and classes used and defined. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import joined

_SCRIPT = r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""
_STYLE = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']stylesheet["'])[^>]*\bhref\s*=\s*["']([^"']+)["']"""


def script_sources(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(_SCRIPT), 1))


def stylesheets(html: Column) -> Column:
    """Targets of stylesheet links, whatever the order of attributes."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(_STYLE), 1))


def html_classes(html: Column) -> Column:
    """Distinct classes of class attributes outside script and style blocks, by lower-case name."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    lists = F.transform(F.regexp_extract_all(body, F.lit(r"""(?i)\bclass\s*=\s*"([^"]*)"|\bclass\s*=\s*'([^']*)'"""), 0), lambda x: F.split(F.trim(F.regexp_extract(x, r"""=\s*["']([^"']*)["']""", 1)), r"\s+"))
    return by_name(F.filter(F.array_distinct(F.flatten(lists)), lambda c: c != ""))


def css_classes(css: Column) -> Column:
    """Distinct `.name` tokens by lower-case name; a plain text scan, so also those in urls."""
    return by_name(F.array_distinct(F.regexp_extract_all(css, F.lit(r"\.(-?[A-Za-z_][A-Za-z0-9_-]*)"), 1)))


def by_name(names: Column) -> Column:
    """Sorted without regard to case, ties by the name itself."""
    return F.transform(F.array_sort(F.transform(names, lambda c: F.struct(F.lower(c), c.alias("name")))), lambda s: s["name"])


def is_local(target: Column) -> Column:
    return target.rlike(r"^\.{0,2}/(?!/)") | ~(target.contains("://") | F.startswith(target, F.lit("//")))


def rule_line(css: Column, name: Column) -> Column:
    """The first line that holds the class, at most 100 characters, or an empty rule."""
    lines = F.filter(F.split(css, "\n"), lambda x: F.contains(F.concat(F.regexp_replace(x, r"[^\w.-]", " "), F.lit(" ")), F.concat(F.lit("."), name, F.lit(" "))))
    line = F.trim(F.get(lines, F.lit(0)))
    return F.when(line.isNull(), F.concat(F.lit("."), name, F.lit(" { ... }"))).when(F.length(line) > 100, F.concat(F.trim(F.substring(line, 1, 100)), F.lit(" ..."))).otherwise(line)


def quick_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """root, file_id, ord, type, target, line, target_file_id, exists: local scripts and stylesheets of pages.

    pages: root, file_id, dir, text; files: root, rel_path, file_id.
    """
    both = F.concat(
        F.transform(script_sources(F.col("text")), lambda t: F.struct(t.alias("target"), F.lit("script").alias("type"))),
        F.transform(stylesheets(F.col("text")), lambda t: F.struct(t.alias("target"), F.lit("stylesheet").alias("type"))),
    )
    rows = pages.select("root", "file_id", "dir", "text", F.posexplode(both).alias("ord", "l")).select("root", "file_id", "dir", "ord", "l.*", F.size(F.split(F.expr("substring_index(text, l.target, 1)"), "\n")).alias("line"))
    rows = rows.where(is_local(F.col("target"))).withColumn("rel_path", joined(F.col("dir"), F.regexp_replace("target", r"[?#].*$", "")))
    known = files.select("root", "rel_path", F.col("file_id").alias("target_file_id"))
    return rows.join(known, ["root", "rel_path"], "left").select("root", "file_id", "ord", "type", "target", "line", "rel_path", "target_file_id", F.col("target_file_id").isNotNull().alias("exists"))


def class_usage(pages: DataFrame, styles: DataFrame, links: DataFrame) -> DataFrame:
    """root, file_id, class, role (matched or missing), src_path: classes of pages against linked and sibling styles.

    Of several styles with a class the one with the smallest path counts. Pages without any local style have no rows.
    """
    linked = links.where("type = 'stylesheet' AND exists").select("root", "file_id", "target_file_id")
    sibling = pages.select("root", "file_id", "dir").join(styles.select("root", "dir", F.col("file_id").alias("target_file_id")), ["root", "dir"]).select("root", "file_id", "target_file_id")
    seen = linked.unionByName(sibling).distinct()
    defined = styles.select(F.col("file_id").alias("target_file_id"), "rel_path", F.explode(css_classes(F.col("text"))).alias("class"))
    available = seen.join(defined, "target_file_id").groupBy("root", "file_id", "class").agg(F.min("rel_path").alias("src_path"))
    used = pages.select("root", "file_id", F.explode(html_classes(F.col("text"))).alias("class")).join(seen.select("root", "file_id").distinct(), ["root", "file_id"], "left_semi")
    return used.join(available, ["root", "file_id", "class"], "left").select("root", "file_id", "class", F.when(F.col("src_path").isNotNull(), "matched").otherwise("missing").alias("role"), "src_path")


def style_consumers(links: DataFrame, pages: DataFrame, styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of a style's own directory that link it, and the classes they use of it or miss in it.

    Returns (root, file_id of the style, page_id, page) and (root, file_id, class, role, page, rule): page is the
    first by name that uses the class, rule the line of the style that has it (null if it is missing).
    """
    place = pages.select(F.col("file_id").alias("page_id"), F.col("dir").alias("page_dir"), F.col("name").alias("page"))
    own = styles.select(F.col("file_id"), F.col("dir").alias("style_dir"))
    consumers = links.where("type = 'stylesheet' AND exists").select("root", F.col("target_file_id").alias("file_id"), F.col("file_id").alias("page_id")).distinct()
    consumers = consumers.join(place, "page_id").join(own, "file_id").where("page_dir = style_dir").select("root", "file_id", "page_id", "page")
    classes = pages.select(F.col("file_id").alias("page_id"), F.explode(html_classes(F.col("text"))).alias("class"))
    used = consumers.join(classes, "page_id").groupBy("root", "file_id", "class").agg(F.min_by("page", F.struct(F.lower("page"), "page")).alias("page"))
    text = F.col("text")
    defined = styles.select("root", "file_id", F.explode(css_classes(text)).alias("class"), text).select("root", "file_id", "class", rule_line(text, F.col("class")).alias("rule"))
    roles = used.join(defined, ["root", "file_id", "class"], "left").select("root", "file_id", "class", F.when(F.col("rule").isNotNull(), "matched").otherwise("missing").alias("role"), "page", "rule")
    return consumers, roles


def script_consumers(links: DataFrame, files: DataFrame) -> DataFrame:
    """root, file_id of a script, page_id: pages whose script resolves to the file, or has its name in the same directory."""
    scripts = links.where("type = 'script'")
    direct = scripts.where("exists").select("root", F.col("target_file_id").alias("file_id"), F.col("file_id").alias("page_id"))
    pages = files.select(F.col("file_id").alias("page_id"), "dir")
    named = scripts.select("root", F.col("file_id").alias("page_id"), F.element_at(F.split(F.regexp_replace("target", r"[?#].*$", ""), "/"), -1).alias("name")).join(pages, "page_id")
    same = named.join(files.select("root", "dir", "name", "file_id"), ["root", "dir", "name"]).select("root", "file_id", "page_id")
    return direct.unionByName(same).distinct()
