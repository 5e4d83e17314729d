"""Mixing sources to target weights by capped water-filling.

Sources share a total by weight; a source whose share is above its cap (a number of epochs) gets
the cap, and the excess is shared again until no share is above. A source is then repeated as many
whole times as its share holds, and a seeded part of its documents once more: documents in the
order of a hash of seed and id until the words wanted are reached. The end of that part is found by
two histograms of the hash, each of at most 4096 bins per source, so no source is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, Scratch, numbered

BITS = 12


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which shares weight * level, cut at cap, add up to the total (columns weight, cap)."""
    level = -1.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return float("inf")
        rising = (total - (row["cap"] or 0)) / row["weight"]
        if rising <= level:
            return level
        level = rising


def targets(scratch: Scratch, sizes: DataFrame, weights: list[int], share: float, epochs: int) -> DataFrame:
    """source, source_size, target: weights are dealt in turn to the sources by code point, null last."""
    order = numbered(scratch, sizes, ["source"], "rank", "ranked")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    shares = scratch.table(order.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * epochs).alias("cap")), "shares")
    total = share * (shares.agg(F.sum("source_size")).first()[0] or 0)
    level = F.lit(water_level(shares, total))
    target = F.when(F.col("weight") * level > F.col("cap"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return shares.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 42,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (all in words).

    taken is the whole repetitions of a document plus the seeded further one. The documents in the
    last bin of the hash share what is left to reach the target, each a part of its words. A null or
    empty text has size 0 and is taken 0 times; null is a source of its own, the last one. Rows that
    repeat an id have the same hash and are treated alike. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mix")
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 6), 16, 10).cast("long")
    docs = scratch.table(
        df.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.shiftright(place, BITS).alias("high"), place.bitwiseAND((1 << BITS) - 1).alias("low"),
        ),
        "docs",
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(scratch, sizes, list(weights), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("wanted", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "of")

    by = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = lambda bins, start: (
        bins.withColumn("before", start + F.sum("n").over(by) - F.col("n")).where((F.col("before") <= F.col("wanted")) & (F.col("wanted") < F.col("before") + F.col("n")))
    )
    first = docs.groupBy(F.col("source").alias("s"), F.col("high").alias("bin")).agg(F.sum("size").alias("n"))
    first = ends(first.join(plan, F.col("s").eqNullSafe(F.col("of"))), F.lit(0)).select("of", F.col("bin").alias("at"), "wanted", F.col("before").alias("start"))
    first = scratch.table(first, "first")
    second = docs.join(first, F.col("source").eqNullSafe(F.col("of")) & (F.col("high") == F.col("at")))
    second = second.groupBy("of", "at", "wanted", "start", F.col("low").alias("bin")).agg(F.sum("size").alias("n"))
    second = ends(second, F.col("start")).select(F.col("of").alias("of2"), "at", F.col("bin").alias("at2"), "before", "n")
    plan = scratch.table(plan.join(second, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"), "plan")

    earlier = (F.col("high") < F.col("at")) | ((F.col("high") == F.col("at")) & (F.col("low") < F.col("at2")))
    last = (F.col("high") == F.col("at")) & (F.col("low") == F.col("at2"))
    part = F.floor(F.col("size") * ((F.col("wanted") - F.col("before")).cast("double") / F.col("n"))).cast("long")
    more = F.when(earlier, F.col("size")).when(last, part).otherwise(F.lit(0))
    return docs.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken")
    )


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, to the nearest whole repetition, with all its columns.

    A row with no words has no share in any count of words and stays once.
    """
    taken = mix(df, id_col, text_col, source_col, **how)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    # rows that repeat an id may differ in source and size, so both belong to the key
    taken = taken.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), times.alias("__times")).distinct()
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (words == F.col("__size"))
    out = df.join(taken.where("__times > 0"), same)
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*df.columns)
