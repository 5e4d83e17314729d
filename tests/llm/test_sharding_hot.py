"""Sharding of groups that hold much of all bytes."""

import itertools

import pytest
from pyspark.sql import functions as F

from symlake.llm import sharding
from symlake.llm._common import Scratch


@pytest.mark.parametrize("salt", [0, 1, 2])
def test_a_group_with_a_third_of_all_bytes_leaves_shards_even(spark, salt):
    rows = [(k, "hot " * 150 if k % 3 == 0 else f"text {salt} {k} ".ljust(600, "x")) for k in range(salt, 6000 + salt)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 6000 and len(sizes) == 8 and sizes.max() <= 1.03 * sizes.mean()


def test_overfull_shards_give_cells_back(spark):
    cells = spark.createDataFrame([(bytes([k // 100]), k, 10, 0, k < 300) for k in range(400)], "group binary, home int, bytes long, shard int, split boolean")
    after = sharding.relieve(Scratch(spark, "test"), cells, 4, 1020.0, 1000.0, 2).toPandas()
    loads = after.groupby("shard")["bytes"].sum()
    assert len(after) == 400 and loads.max() <= 1030 and set(after[after.home >= 300].shard) == {0}


def test_cut_edges_against_brute_force(spark):
    sizes = [3, 5, 2, 4, 6, 3, 5, 4, 2, 6]
    rows = [(100 * g + k, f"{g} {k} ".ljust(99, "x"), g) for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, team int")
    got = {r["id"]: r["shard"] for r in sharding.shard(df, shards=2, link=F.col("team")).collect()}
    # the fewest edges (pairs of a team) that a split with loads at most a tenth apart must cut, over all splits of whole teams
    total = sum(sizes)
    whole = min(abs(2 * sum(n for n, side in zip(sizes, sides, strict=True) if side) - total) for sides in itertools.product((0, 1), repeat=len(sizes)))
    assert whole <= 0.1 * total  # so no edge needs to be cut
    cut = sum(got[a] != got[b] for g, n in enumerate(sizes) for a, b in itertools.combinations([100 * g + k for k in range(n)], 2))
    loads = [sum(v == side for v in got.values()) for side in (0, 1)]
    assert cut <= 0.25 * sum(n * (n - 1) // 2 for n in sizes) and abs(loads[0] - loads[1]) <= max(sizes)
