"""Sharding by balanced label propagation.

Linked documents (by default those of equal text) should share a shard while shards hold nearly equal bytes.
Documents start spread evenly over the shards. In every round each document wants to move to the shard that
holds most of its neighbours' bytes; quotas for each pair of shards, from the demand in both directions and
the room left, decide which share of the movers goes. Documents without neighbours then fill what room is
left, first the large ones and then, to an even level, the small ones.

Neighbours are found through their group, never as pairs, and the documents of a group with the same `home`
(one of `HOMES` by a hash, of more in a large group) move as one cell, so that the state has a bounded number of
rows for a group of any size and a cell is about `CELL` of a shard at most. Movers are admitted by running sums of
their bytes up to the quota; cells then leave shards that are too full, those of large groups first. All of it is
DataFrame operations; the driver sees matrices of shards by shards only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, small

#: Cells that a group's documents are dealt to, and rows of a block within which slots are counted.
HOMES, BLOCK_ROWS = 64, 20_000
#: Part of a shard that a cell of a large group holds on average.
CELL = 0.0005


def quotas(demand: list[list[int]], load: list[int], capacity: float) -> list[list[float]]:
    """The share of each demand (bytes that want to go from shard s to t) that may move.

    What two shards would exchange always may; of the rest a shard takes what it has room for.
    """
    n = len(load)
    swap = [[min(demand[s][t], demand[t][s]) for t in range(n)] for s in range(n)]
    share = [[0.0] * n for _ in range(n)]
    for t in range(n):
        more = sum(demand[s][t] - swap[s][t] for s in range(n))
        open_ = min(1.0, max(0.0, capacity - load[t]) / more) if more else 0.0
        for s in range(n):
            if demand[s][t]:
                share[s][t] = (swap[s][t] + open_ * (demand[s][t] - swap[s][t])) / demand[s][t]
    return share


def _table(values: list[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))


def _running(cells: DataFrame, by: list[str], block: Column, *order: str | Column) -> DataFrame:
    """Adds `before`, the bytes of earlier cells with the same values of `by`; blocks by number, then by `order`."""
    parts = cells.withColumn("block", block)
    sums = parts.groupBy(*by, "block").agg(F.sum("bytes").alias("of_block"))
    earlier = sums.select(*by, "block", (F.sum("of_block").over(Window.partitionBy(*by).orderBy("block")) - F.col("of_block")).alias("earlier"))
    within = F.sum("bytes").over(Window.partitionBy(*by, "block").orderBy(*order)) - F.col("bytes")
    return parts.withColumn("within", within).join(small(earlier), [*by, "block"]).withColumn("before", F.col("earlier") + F.col("within")).drop("block", "within", "earlier")


def relieve(scratch: Scratch, cells: DataFrame, shards: int, capacity: float, level: float, blocks: int) -> DataFrame:
    """The cells (group, home, bytes, shard, split) after those beyond the capacity went where there is room, cells of split groups first."""
    load = [0] * shards
    for r in cells.groupBy("shard").agg(F.sum("bytes").alias("n")).collect():
        load[r["shard"]] = r["n"]
    excess, room = [max(0.0, x - capacity) for x in load], [max(0.0, level - x) for x in load]
    if not any(excess) or not any(room):
        return cells
    starts, ends, at = [], [], 0.0
    for x in excess:
        starts.append(at)
        at += x
    scale, at = at / sum(room), 0.0
    for x in room:
        at += x * scale
        ends.append(at)
    over = _table(excess, F.col("shard"))
    block = F.pmod(F.xxhash64(F.lit(3), "group", "home"), F.lit(blocks)) + F.when(F.col("split"), 0).otherwise(blocks)
    movable = _running(cells.where(F.col("bytes") <= over), ["shard"], block, "group", "home")
    middle = _table(starts, F.col("shard")) + F.col("before") + F.col("bytes") / 2
    others = [t for t in range(shards) if room[t]]
    to = F.lit(others[-1])
    for t in reversed(others[:-1]):
        to = F.when(middle < F.lit(ends[t]), F.lit(t)).otherwise(to)
    moved = movable.where(F.col("before") < over).select("group", "home", to.cast("int").alias("to"))
    return scratch.table(cells.join(moved, ["group", "home"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "relieved")


def propagate(scratch: Scratch, cells: DataFrame, shards: int, capacity: float, rounds: int, blocks: int = 1) -> DataFrame:
    """The cells (group, home, bytes, shard) after at most so many rounds, fewer if nothing wants to move."""
    for turn in range(rounds):
        held = cells.groupBy("group", "shard").agg(F.sum("bytes").alias("held"))
        votes = held.groupBy("group").agg(F.max_by("shard", F.struct("held", F.xxhash64("group", "shard"))).alias("best"))
        wish = scratch.table(cells.join(votes, "group"), f"wish-{turn}")
        counts = wish.groupBy("shard", "best").agg(F.sum("bytes").alias("n")).collect()
        demand, load = [[0] * shards for _ in range(shards)], [0] * shards
        for r in counts:
            load[r["shard"]] += r["n"]
            if r["shard"] != r["best"]:
                demand[r["shard"]][r["best"]] = r["n"]
        share = quotas(demand, load, capacity)
        if not any(x for row in share for x in row):
            return wish.drop("best")
        allowed = _table([x * n for row, some in zip(share, demand, strict=True) for x, n in zip(row, some, strict=True)], F.col("shard") * shards + F.col("best"))
        mixed = F.xxhash64(F.lit(turn), "group", "home")
        going = _running(wish, ["shard", "best"], F.pmod(mixed, F.lit(blocks)), mixed, "group", "home")
        goes = F.col("before") + F.col("bytes") <= allowed + 1e-6 * F.col("bytes")
        cells = going.select(*cells.columns[:3], F.when(goes, F.col("best")).otherwise(F.col("shard")).alias("shard"), *cells.columns[4:])
        cells = scratch.table(cells, f"cells-{turn}")
        scratch.drop(f"wish-{turn}", f"cells-{turn - 1}")
    return cells


def _fill(scratch: Scratch, docs: DataFrame, load: list[int], level: float, blocks: int, name: str) -> tuple[DataFrame, list[int]]:
    """Puts documents (row, bytes) one after another into the room under the level; loads afterwards."""
    room = [max(0.0, level - x) for x in load]
    block = F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(blocks))
    parts = docs.withColumn("block", block)
    sums = parts.groupBy("block").agg(F.sum("bytes").alias("of_block"))
    before = sums.select("block", (F.sum("of_block").over(Window.orderBy("block")) - F.col("of_block")).alias("before"))
    total = docs.agg(F.sum("bytes")).first()[0] or 0
    scale = total / sum(room) if sum(room) else 0.0
    ends, at = [], 0.0
    for x in room:
        at += x * scale if scale else total / len(room)
        ends.append(at)
    middle = F.col("before") + F.sum("bytes").over(Window.partitionBy("block").orderBy("row")) - F.col("bytes") / 2
    shard = sum((F.when(middle >= F.lit(e), F.lit(1)).otherwise(F.lit(0)) for e in ends[:-1]), F.lit(0))
    put = scratch.table(parts.join(small(before), "block").select("row", "bytes", shard.cast("int").alias("shard")), name)
    load = list(load)
    for r in put.groupBy("shard").agg(F.sum("bytes").alias("n")).collect():
        load[r["shard"]] += r["n"]
    return put, load


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, link: Column | None = None, rounds: int = 8, slack: float = 0.02) -> DataFrame:
    """One row per input row: id, size, crc32, shard, slot (gapless from 0 in its shard).

    size is the bytes of the text in UTF-8 (null: none) plus 1. Documents with the same value of `link` (default:
    the text, null counting as empty; null values of another link join nothing) are linked. Groups larger than a
    shard are split. Rows that repeat are documents like others and linked to each other. An empty table gives an
    empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary"))) if link is None else F.when(link.isNotNull(), F.unhex(F.md5(link.cast("string").cast("binary"))))
    docs = scratch.table(
        df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("crc32"), key.alias("group")),
        "docs",
    )
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    rows, total = whole["n"], whole["bytes"] or 0
    blocks, level = max(1, -(-rows // BLOCK_ROWS)), total / shards
    home = lambda n: F.pmod(F.xxhash64(F.lit(0), F.col("row")), n).cast("int")
    # groups that need more cells are few, as each holds some part of a shard
    coarse = docs.where(F.col("group").isNotNull()).groupBy("group", home(F.lit(HOMES)).alias("home")).agg(F.sum("bytes").alias("bytes"))
    split = coarse.groupBy("group").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > HOMES * CELL * level)
    split = scratch.table(split.select("group", F.ceil(F.col("bytes") / (CELL * max(level, 1.0))).cast("int").alias("homes")), "split")
    docs = docs.join(F.broadcast(split), "group", "left").withColumn("home", home(F.coalesce("homes", F.lit(HOMES)))).drop("homes")
    # cells of groups with two documents at least
    counted = docs.where(F.col("group").isNotNull()).groupBy("group", "home").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    tied = counted.groupBy("group").agg(F.sum("n").alias("n")).where("n > 1").select("group")
    cells = counted.join(tied, "group", "left_semi").join(F.broadcast(split.withColumn("split", F.lit(True))), "group", "left")
    cells = scratch.table(cells.select("group", "home", "bytes", (F.col("home") % shards).alias("shard"), F.coalesce("split", F.lit(False)).alias("split")), "cells")
    cells = scratch.table(propagate(scratch, cells, shards, (1 + slack) * level, rounds, blocks), "moved")
    cells = relieve(scratch, cells, shards, (1 + slack) * level, level, blocks)
    spread = docs.join(cells.select("group", "home", F.col("shard").alias("put")), ["group", "home"], "left").select("row", "id", "bytes", "crc32", "put")
    spread = scratch.table(spread, "spread")
    load = [0] * shards
    for r in spread.where("put IS NOT NULL").groupBy("put").agg(F.sum("bytes").alias("n")).collect():
        load[r["put"]] += r["n"]
    single, mean = spread.where("put IS NULL").select("row", "bytes"), total / rows if rows else 0
    large, load_large = _fill(scratch, single.where(F.col("bytes") > mean), load, level, blocks, "large")
    rest, _ = _fill(scratch, single.where(F.col("bytes") <= mean), load_large, level, blocks, "rest")
    filled = large.unionByName(rest).select("row", "shard")
    placed = spread.join(filled, "row", "left").select("row", "id", "bytes", "crc32", F.coalesce("put", "shard").alias("shard"))
    placed = scratch.table(placed.withColumn("block", F.pmod(F.xxhash64(F.lit(2), F.col("row")), F.lit(blocks))), "placed")
    scratch.keep("placed")
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return placed.join(small(before), ["shard", "block"]).select("id", F.col("bytes").alias("size"), "crc32", "shard", slot.cast("long").alias("slot"))
