"""Line dedup over a suffix array of line-ID sequences.

Lines are named by their rank among the repeated lines of the corpus. Prefix doubling then ranks the suffixes of
all documents by their first 1, 2, 4, ... lines, to the end: a suffix's rank at twice the depth is that of its own
rank and the rank found as many lines further on, among all such pairs in order. Suffixes of equal rank form an
interval of the suffix array whose longest common prefix is at least the depth; those of an interval with one
member are unique and leave, so each round works on repeated runs only, and the rounds end with the longest.

The ranks also give longest common prefixes without looking at lines: two suffixes go on alike for another 2^k lines
if their ranks of that depth are equal there. Each place is extended so against the earliest place of its deepest
interval; what is not inside the run of the place before it is a maximal repeated run.

A line is deleted if it lies in a run of at least `min_lines` lines, or is a line of at least `min_words` words,
that occurs earlier. Every run of at least min_lines lines is a union of runs of that length, each of which
occurs earlier where the whole one does, so the intervals of that depth decide exactly about runs of any length: a
later copy of a maximal repeated run goes as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, Scratch, numbered, split_join

PLACE = ["late", "id", "row", "line"]


def _ranked(scratch: Scratch, keyed: DataFrame, key: list[str], name: str) -> DataFrame:
    """Places whose key occurs twice or more, with the key's rank, whether an earlier place has it, and if so the earliest."""
    groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    groups = scratch.table(numbered(scratch, groups, key, "rank", f"{name}-groups"), f"{name}-ranks")
    scratch.drop(f"{name}-groups")
    again = F.struct(*PLACE) != F.col("first")
    more = [c for c in ("enough",) if c in keyed.columns]
    found = split_join(keyed, groups, key, "n").select(*PLACE, "rank", *more, again.alias("again"), F.when(again, F.col("first")).alias("first"))
    found = scratch.table(found, name)
    scratch.drop(f"{name}-ranks")
    return found


def _further(scratch: Scratch, level: DataFrame, step: int, name: str) -> DataFrame | None:
    """Places of a level that have another of it `step` lines further on, ranked by both; None if there are none that repeat."""
    on = level.select(F.col("row").alias("r"), (F.col("line") - step).alias("l"), F.col("rank").alias("next"))
    pairs = level.join(on, (F.col("row") == F.col("r")) & (F.col("line") == F.col("l"))).select(*PLACE, F.col("rank").alias("own"), "next")
    pairs = scratch.table(pairs, f"{name}-pairs")
    found = _ranked(scratch, pairs, ["own", "next"], name) if pairs.limit(1).count() else None
    scratch.drop(f"{name}-pairs")
    return found if found is not None and found.limit(1).count() else None


def suffix_ranks(scratch: Scratch, single: DataFrame) -> list[DataFrame]:
    """Ranks of the suffixes that are tied at 1, 2, 4, ... lines, down to the depth at which none is."""
    levels = [single]
    while (deeper := _further(scratch, levels[-1], 1 << (len(levels) - 1), f"depth-{1 << len(levels)}")) is not None:
        levels.append(deeper)
    return levels


def maximal_runs(scratch: Scratch, levels: list[DataFrame]) -> DataFrame:
    """row, line, lines, of_id, of_line: runs that occur earlier, each with the place it is a copy of; none lies in the run of the line before."""
    runs = None
    for k in reversed(range(len(levels))):
        deepest = levels[k].where("again")
        if k + 1 < len(levels):
            deepest = deepest.join(levels[k + 1].where("again").select("row", "line"), ["row", "line"], "left_anti")
        found = deepest.select("row", "line", F.col("first.id").alias("of_id"), F.col("first.row").alias("of_row"), F.col("first.line").alias("of_line"), F.lit(1 << k).alias("lines"))
        if runs is not None:
            own = levels[k].select(F.col("row").alias("r"), F.col("line").alias("l"), F.col("rank").alias("a"))
            other = levels[k].select(F.col("row").alias("s"), F.col("line").alias("m"), F.col("rank").alias("b"))
            on = runs.join(own, (F.col("row") == F.col("r")) & (F.col("line") + F.col("lines") == F.col("l")), "left")
            on = on.join(other, (F.col("of_row") == F.col("s")) & (F.col("of_line") + F.col("lines") == F.col("m")), "left")
            longer = F.col("lines") + F.when(F.col("a") == F.col("b"), 1 << k).otherwise(0)
            found = found.unionByName(on.select("row", "line", "of_id", "of_row", "of_line", longer.cast("int").alias("lines")))
        runs = scratch.table(found, f"runs-{k}")
        scratch.drop(f"runs-{k + 1}")
    before = Window.partitionBy("row").orderBy("line")
    inside = (F.lag("line").over(before) == F.col("line") - 1) & (F.lag("lines").over(before) > F.col("lines"))
    return runs.withColumn("inside", F.coalesce(inside, F.lit(False))).where("NOT inside").select("row", "line", "lines", "of_id", "of_line")


def repeated_lines(scratch: Scratch, docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """Of documents (row, id, text): row, the sorted lines to delete and the maximal runs, for rows that have any."""
    lines = docs.select(F.col("id").isNull().alias("late"), "id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    enough = F.regexp_count("words", F.lit(WORD)) >= min_words
    named = scratch.table(lines.select(*PLACE, F.xxhash64("words").alias("a"), F.xxhash64(F.lit("second"), "words").alias("b"), enough.alias("enough")), "lines")
    single = _ranked(scratch, named, ["a", "b"], "depth-1")
    scratch.drop("lines")
    levels = suffix_ranks(scratch, single)
    whole = min_lines.bit_length() - 1  # the level of the largest power of two up to min_lines
    level = levels[whole] if whole < len(levels) else None
    if level is not None and min_lines > 1 << whole:
        level = _further(scratch, level, min_lines - (1 << whole), "depth-least")
    gone = single.where("again AND enough").select("row", "line")
    if level is not None:
        gone = gone.unionByName(level.where("again").select("row", F.explode(F.sequence(F.col("line"), F.col("line") + (min_lines - 1))).alias("line")))
    gone = gone.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    runs = maximal_runs(scratch, levels).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "lines", "of_id", "of_line"))).alias("runs"))
    return scratch.table(runs.join(gone, "row", "left"), "gone")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, deleted = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own, drop = (text.split("\n") if text is not None else []), set(gone or ())
            lines.append(len(own))
            deleted.append(len(drop))
            texts.append(None if text is None else text if not drop else "\n".join(x for k, x in enumerate(own) if k not in drop))
        columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(deleted, pa.int64()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "lines", "deleted", "runs"])


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 1) -> DataFrame:
    """One row per input row: id, text without deleted lines, lines (before), deleted, runs.

    runs are the maximal repeated runs that occur earlier (null if there are none): first line from 0, lines, and the
    document and line of the earliest place that shares the largest power of two of the run's lines. Lines end at
    U+000A; words are separated by U+0020 and U+0009 to U+000D. Earlier means a smaller id (null last), then an earlier
    row of the input, then an earlier line; so the first copy stays, also within a document. A null text stays null with
    0 lines; an empty text is one empty line. Rows that repeat an id are documents of their own. An empty table gives an
    empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "lines")
    # written once, since both uses must see the same row numbers
    docs = scratch.table(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "docs")
    gone = repeated_lines(scratch, docs, min_lines, min_words)
    scratch.keep("docs", "gone")
    kind = df.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, text string, lines long, deleted long, runs array<struct<line:int,lines:int,of_id:{kind},of_line:int>>"
    # the same join at every size, whatever the size of `gone`
    return docs.join(gone.hint("merge"), "row", "left").select("id", "text", "gone", "runs").mapInArrow(_cut, shape)
