"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; an exact count verifies them and
picks their winners, and that table of at most `counters` rows is broadcast, so that the rows of
hot groups never leave their task. All other digests take the ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, lowered, one_of_each, small


def misra_gries(counts: Counter, more: Counter, counters: int) -> Counter:
    """Merges two summaries into one of at most `counters` counters.

    Each count is below the true one by at most the total divided by counters + 1.
    """
    merged = counts + more
    if len(merged) <= counters:
        return merged
    cut = sorted(merged.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in merged.items() if v > cut})


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found = misra_gries(found, Counter(batch.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["digest", "n"])

    return run


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256).

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row with the
    largest id of a group stays, a null id being smaller than any other; of rows that repeat that
    id exactly one stays. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "exact")
    keyed = scratch.table(
        df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(lowered(F.col(text_col)), 256)).alias("digest")),
        "keyed",
    )
    top = F.max(F.struct("id", "row")).alias("top")
    likely = (
        keyed.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    )
    winners = scratch.table(
        keyed.join(F.broadcast(likely.select("digest")), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), top).where("group_size > 1"),
        "winners",
    )
    hot = keyed.join(F.broadcast(winners), "digest")
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), top)
    return hot.unionByName(rest.join(groups, "digest")).select(
        "id", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "digest"
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that repeat id and text the earliest stays."""
    marked = Scratch(df.sparkSession, "kept").table(copies(df, id_col, text_col), "marked")
    gone = marked.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("__id"), F.col("digest").alias("__gone")).distinct()
    rows = df.withColumn("__digest", F.unhex(F.sha2(lowered(F.col(text_col)), 256)))
    kept = rows.join(small(gone), rows[id_col].eqNullSafe(F.col("__id")) & (rows["__digest"] == F.col("__gone")), "left_anti")
    if marked.where(F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1).count():
        kept = one_of_each(kept, [id_col, "__digest"], marked.select(F.col("id").alias(id_col), F.col("digest").alias("__digest")))
    return kept.drop("__digest")
