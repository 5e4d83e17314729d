"""The pipeline's near copies against brute-force Jaccard."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symlake.llm import near_sets


def brute_kept(rows, width=5):
    """Places of the rows (id, text) that stay."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min((key is None, key or 0, i), least.get(top(i), (key is None, key or 0, i)))
    return {x[2] for x in least.values()}


def varied(seed, bases, copies):
    """Texts of 8 to 200 words, each with copies in which a few words differ, with a common passage and odd rows."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, common = [], " ".join(word() for _ in range(12))
    for _ in range(bases):
        base = [word() for _ in range(int(rng.integers(8, 200)))]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, max(2, len(own) // 20)))):
                own[at] = word()
            rows.append(" ".join(own) + (" " + common if rng.random() < 0.5 else ""))
    rows += ["", " \t", None, "one two", "ONE  two", "one two three"]
    return [(None if k % 17 == 0 else int(k) // 2, rows[k]) for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("limit", [64, 3])
def test_near_copies_against_brute_jaccard(spark, limit):
    rows = varied(limit, 20, 12)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long").coalesce(1)
    assert {r["place"] for r in near_sets.drop_near_copies(df, limit=limit).collect()} == brute_kept(rows)
    assert near_sets.drop_near_copies(df.limit(0)).count() == 0


def test_broadcasts_stay_bounded(spark, monkeypatch):
    bound, broadcast, seen = 40, F.broadcast, []
    for name, value in (("TOLD", 10), ("BITS", 64 * bound), ("FREQUENT", bound)):
        monkeypatch.setattr(near_sets, name, value, raising=False)
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append(df.count()) or broadcast(df))
    plans, table = {}, near_sets.Scratch.table
    monkeypatch.setattr(near_sets.Scratch, "table", lambda self, df, name: plans.update({name: df._jdf.queryExecution().toString()}) or table(self, df, name))
    rows = varied(5, 20, 12)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long").coalesce(1)
    assert {r["place"] for r in near_sets.drop_near_copies(df, limit=3).collect()} == brute_kept(rows)
    assert seen and max(seen) <= 1.5 * bound
    # rows dealt to all parts are more than the planner thinks
    assert re.search(r"SortMergeJoin \[key#\d+L, part#\d+\]", plans["more"])


def test_the_stage_drops_copies_of_similarity_four_fifths(spark):
    words = [f"w{k}" for k in range(204)]
    near, far = list(words), list(words)
    for at in (10, 50, 90, 130):  # 20 of 200 shingles each: 180 / 220 = 0.82
        near[at] = "other"
    for at in (10, 50, 90, 130, 170):  # 175 / 225 = 0.78
        far[at] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]
