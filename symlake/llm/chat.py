"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant and all others
as named users; the mask marks what the assistant says, which is what a model learns. The rendered dialogue is
kept as one row per turn and perspective, with the place of each piece in it, so that a dialogue of any length
is never gathered into one row. Places are running sums over blocks of turns that are dealt by range, with the
sums of earlier blocks added. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, partitions, small

#: Fixed values of the rendered form.
OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "\n"


def head(speaker: Column, is_assistant: Column) -> Column:
    """The line above a turn."""
    name = F.regexp_replace(speaker, r"[\s<|>]+", "_")
    return F.concat(F.lit(OPEN), F.when(is_assistant, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name)), F.lit(LINE))


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn and perspective: conv, perspective, seq, turn, speaker, piece, start, learn_start, learn_end, end.

    seq counts the turns of a dialogue from 0 in the order of turn (null last); turns that tie follow speaker and
    text. The piece stands at [start, end) of the rendered dialogue, in code points; [learn_start, learn_end) is
    the part that is learned, its text and the closing mark, and is empty for the turns of others. A null speaker
    is the participant `unknown`, a null text an empty turn, and rows with a null dialogue belong to one dialogue.
    Rows that repeat are turns like others. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "chat")
    order = ["turn", "speaker", "text"]
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = scratch.table(rows.repartitionByRange(partitions(df.sparkSession), F.col("conv").asc_nulls_last(), *by).withColumn("block", F.spark_partition_id()), "dealt")
    # lengths of a turn as the user of its own name and as the assistant differ by the head only
    own, other = head(F.col("speaker"), F.lit(True)), head(F.col("speaker"), F.lit(False))
    lengths = dealt.withColumns({"as_own": F.length(own), "as_other": F.length(other), "rest": F.length("text") + len(CLOSE + LINE)})
    block = lengths.groupBy("conv", "block", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum("as_own").alias("own"), F.sum("as_other").alias("other"), F.sum("rest").alias("rest"))
    block = scratch.table(block, "blocks")
    people = block.select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    # what each perspective has before a block: all turns as others, its own as the assistant
    sums = block.groupBy("conv", "block").agg(F.sum("n").alias("n"), F.sum(F.col("other") + F.col("rest")).alias("size"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"))
    turned = block.select(F.col("conv").alias("tc"), F.col("block").alias("tb"), F.col("speaker").alias("p"), (F.col("own") - F.col("other")).alias("gain"))
    grid = sums.join(people, F.col("conv").eqNullSafe(F.col("of"))).select(F.col("conv").alias("c"), F.col("block").alias("b"), "perspective", "n_before", "size_before")
    grid = grid.join(turned, F.col("c").eqNullSafe(F.col("tc")) & (F.col("b") == F.col("tb")) & (F.col("perspective") == F.col("p")), "left")
    gained = Window.partitionBy("c", "perspective").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("c", "b", "perspective", "n_before", (F.col("size_before") + F.coalesce(F.sum("gain").over(gained), F.lit(0))).alias("before"))
    within = Window.partitionBy("conv", "block").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = lengths.withColumn("at", F.row_number().over(Window.partitionBy("conv", "block").orderBy(*by)) - 1)
    turns = turns.withColumn("others", F.sum(F.col("as_other") + F.col("rest")).over(within) - F.col("as_other") - F.col("rest"))
    seen = turns.join(small(grid), F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    is_own = F.col("speaker") == F.col("perspective")
    spoken = Window.partitionBy("conv", "block", "perspective").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = F.when(is_own, F.col("as_own") - F.col("as_other")).otherwise(F.lit(0))
    start = F.col("before") + F.col("others") + F.sum(gain).over(spoken) - gain
    headed = F.when(is_own, F.col("as_own")).otherwise(F.col("as_other"))
    return seen.select(
        "conv", "perspective", (F.col("n_before") + F.col("at")).alias("seq"), "turn", "speaker",
        F.concat(head(F.col("speaker"), is_own), F.col("text"), F.lit(CLOSE + LINE)).alias("piece"), start.alias("start"), headed.alias("headed"), "rest", is_own.alias("learned"),
    ).select(
        "conv", "perspective", "seq", "turn", "speaker", "piece", "start", (F.col("start") + F.col("headed")).alias("learn_start"),
        (F.col("start") + F.col("headed") + F.when(F.col("learned"), F.col("rest") - len(LINE)).otherwise(F.lit(0))).alias("learn_end"), (F.col("start") + F.col("headed") + F.col("rest")).alias("end"),
    )
