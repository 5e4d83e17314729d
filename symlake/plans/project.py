"""A project's tables, composed lazily from its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import tag_problems
from ..operators import graph, links, summary, web
from ..operators.extract import extract
from ..sources import tree
from .shared import Shared

#: What stands before the names of the files' own columns in a table that also holds their analyses.
KEPT = "__of_"


@dataclass
class Project:
    """The tables of one or many source trees; every one is a DataFrame that nothing has run yet."""

    files: DataFrame
    analyses: DataFrame
    symbols: DataFrame
    calls: DataFrame
    relations: DataFrame
    dependencies: DataFrame
    cross_calls: DataFrame
    incoming_calls: DataFrame
    related: DataFrame
    packages: DataFrame
    quick_links: DataFrame
    css_usage: DataFrame
    style_consumers: DataFrame
    style_usage: DataFrame
    script_consumers: DataFrame
    summary: DataFrame

    def views(self, prefix: str = "") -> None:
        """Registers every table as a temporary view, for Spark SQL."""
        for name, table in vars(self).items():
            table.createOrReplaceTempView(prefix + name)


def project(files: DataFrame, max_imported: int | None = None, max_incoming: int | None = None, max_side_bytes: int = tree.MAX_SIDE_BYTES, shared: Shared | None = None, listing: DataFrame | None = None) -> Project:
    """Tables of files with root, rel_path, path, length, text, gate, file_id and the classified columns.

    Web joins read HTML and CSS up to max_side_bytes. Cross-file relations have no cap unless one is given; files that a
    cap cuts get a notice. With a shared folder files are parsed once, into a table there, instead of once for each use; that
    table holds the files as well, unless there is a listing. Files of the listing whose text got lost on the way are unreadable.
    """
    together = shared is not None and listing is None
    analyses = extract(files, KEPT if together else "")
    if shared is not None:
        analyses = shared.table(analyses, "analyses")
    kept, whole = [KEPT + c for c in files.columns], analyses
    if together:
        files, analyses = whole.select(*[F.col(KEPT + c).alias(c) for c in files.columns]), whole.drop(*kept)
    if listing is not None:
        lost = listing.join(analyses.select("file_id"), "file_id", "left_anti").withColumns({"text": F.lit(None).cast("string"), "gate": F.lit("unreadable")})
        analyses = analyses.unionByName(extract(lost))
    symbols = graph.symbols(analyses)
    calls = graph.relations(symbols)
    if together:  # root and dir are at hand
        placed = links.dependency_rows(whole.withColumns({"root": F.col(KEPT + "root"), "dir": F.col(KEPT + "dir")}), ["root", "dir"])
    else:
        placed = links.dependency_rows(analyses).join(files.select("file_id", "root", "dir"), "file_id")
    deps = links.resolve(placed, files)
    cross = graph.cross_file_calls(symbols, deps, max_imported)
    worth = graph.worth_incoming(symbols).select(F.col("file_id").alias("target_file_id"))
    incoming = cross.join(worth, "target_file_id", "left_semi")
    side = files.where((F.col("length") <= max_side_bytes) & F.col("text").isNotNull())
    pages, styles = side.where("language = 'html'"), side.where("language = 'css'")
    quick = web.quick_links(pages, files)
    consumers, usage = web.style_consumers(quick, pages, styles)
    return Project(
        files=files, analyses=graph.noticed(analyses, deps, incoming, max_imported, max_incoming), symbols=symbols, calls=calls, relations=graph.with_reverse(calls), dependencies=deps, cross_calls=cross,
        incoming_calls=graph.incoming_calls(incoming, max_incoming), related=links.related(files), packages=links.packages(files), quick_links=quick, css_usage=web.class_usage(pages, styles, quick),
        style_consumers=consumers, style_usage=usage, script_consumers=web.script_consumers(quick, files), summary=summary.project_summary(files),
    )


def open_tree(spark: SparkSession, root: str, **how) -> Project:
    """The project of a folder that Spark can read; its files are parsed once. A file that cannot be read gets a notice."""
    shared = how.pop("shared", None) or Shared(spark, "tree")
    crawled = tree.limited(tree.crawl(tree.read_tree(spark, root)))
    return project(tree.sources(crawled), shared=shared, listing=tree.sources(crawled.withColumn("content", F.lit(None).cast("binary"))), **how)


def from_texts(texts: DataFrame, any_suffix: bool = False, **how) -> Project:
    """The project of a table with root, rel_path and text; files that a crawl would leave out take part with any_suffix."""
    files = texts.withColumns({"path": F.concat_ws("/", "root", "rel_path"), "length": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    files = tree.classify(files) if any_suffix else tree.crawl(files)
    files = files.withColumns({"file_id": F.md5(F.concat_ws("\u0000", "root", "rel_path")), "gate": tree.gate(F.col("name"), F.col("language"), F.col("length"), F.col("text"))})
    return project(files, **how)


def _tag_diagnostics(batches):
    import pyarrow as pa

    for batch in batches:
        keys, ords, lines, columns, messages = [], [], [], [], []
        for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for n, (message, line, column) in enumerate(tag_problems(html or "")):
                keys.append(key)
                ords.append(n)
                messages.append(message)
                lines.append(line)
                columns.append(column)
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(ords, pa.int32()), pa.array(messages, pa.string()), pa.array(lines, pa.int32()), pa.array(columns, pa.int32())], names=["key", "ord", "message", "line", "col"])


def tag_diagnostics(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ord, message, line, col: tags of each page that do not match."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(_tag_diagnostics, f"key {kind}, ord int, message string, line int, col int")
