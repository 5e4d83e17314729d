"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints of 8 bytes that differ in at most 4 bits share at least 4 bytes at the same positions.
Any 4 of the 8 positions hold one of 20 fixed triples (a Turan system), so the inverted index has a
posting list for each triple of positions and its three bytes, not for single bytes, whose lists would
grow with the square of the corpus. Within a list, the shared positional bytes of each pair are tallied,
pairs with fewer than the guaranteed 4 are left, and the others are verified by the differing bits. A list
returns the links of a spanning forest only. A list longer than `posting_limit` is dealt to blocks, and every
two blocks of it are tallied as a list of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Scratch, release, small, split_join
from .components import components

DISTANCE, BYTES = 4, 8
SHARED = BYTES - DISTANCE
#: Shingles hashed at once.
STEP = 1 << 16
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions such that any 4 positions hold one of them."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [g for g in groups if len(g) == 3]
    for k, g in enumerate(groups):
        found += [(*pair, one) for pair in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return [tuple(sorted(t)) for t in found]


def spans(text: bytes | None, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The folded words of a text, joined by spaces, and where its shingles start and end there; one empty shingle without words."""
    words = (text or b"").translate(_FOLD).split()
    if not words:
        return b"", np.zeros(1, np.int64), np.zeros(1, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    return joined, starts[: len(words) - width + 1], ends[width - 1 :]


def hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of the spans of a text."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(found: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(found), STEP):
        some = found[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(found), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of a text as a signed 64-bit number.

    Words are separated by U+0020 and U+0009 to U+000D; shingles hold `width` words, a shorter text is
    one shingle, and a text without words has fingerprint 0. A bit is set if more than half of the
    shingles' hashes (XXH64, seed 42), repeats included, have it set.
    """
    joined, starts, ends = spans(text, width)
    return majority(hashes(joined, starts, ends)) if joined else 0


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])
        release()

    return run


def unite(roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the sets of left[k] and right[k]; roots[x] is the smallest member of x's set before and after."""
    while True:
        a, b = roots[left], roots[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := roots[roots], roots):
            roots[:] = up


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a spanning forest of each posting list; keys are sorted, equal keys form a list."""
    n = len(keys)
    ends = np.searchsorted(keys, keys, side="right")
    roots, at = np.arange(n), np.arange(n)
    for step in range(1, n):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        differ = fps[at] ^ fps[at + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= SHARED
        near = at[shared][np.bitwise_count(differ[shared].view(np.uint64)) <= DISTANCE]
        unite(roots, near, near + step)
    tied = np.flatnonzero(roots != np.arange(n))
    return fps[tied], fps[roots[tied]]


def _posting_links(limit: int | None):
    """Links of the posting lists (key, fp), sorted by key; of a list over the limit the fingerprints and the key, marked long."""

    def out(u: np.ndarray, v: np.ndarray, long: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(np.full(len(u), long))], names=["u", "v", "long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, overlong = np.empty(0, np.int64), np.empty(0, np.int64), None

        def done(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, counts = np.unique(k, return_counts=True)
            big = np.repeat(counts > limit, counts) if limit else np.zeros(len(k), bool)
            if big.any():
                yield out(f[big], k[big], True)
            use = ~big & np.repeat(counts > 1, counts)
            if use.any():
                u, v = linked(k[use], f[use])
                if len(u):
                    yield out(u, v, False)

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if overlong is not None:  # the rest of a long list
                same = int(np.searchsorted(k, overlong, side="right"))
                if same:
                    yield out(f[:same], k[:same], True)
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                overlong = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from done(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
            if limit and len(keys) > limit:
                yield out(fps, keys, True)
                overlong, keys, fps = keys[0], keys[:0], fps[:0]
        yield from done(keys, fps)

    return run


def links(scratch: Scratch, fps: DataFrame, posting_limit: int = 4096) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) that join every two at most 4 bits apart, directly or by other such links."""
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)
    filed = [
        F.lit(n << 24).cast("long").bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c))
        for n, (a, b, c) in enumerate(position_triples())
    ]
    sort = lambda lists: lists.repartition("key").sortWithinPartitions("key", "fp")
    lists = fps.select(F.explode(F.array(*filed)).alias("key"), "fp")
    found = scratch.table(sort(lists).mapInArrow(_posting_links(posting_limit), "u long, v long, long boolean"), "found")
    short = found.where("NOT long").select("u", "v")
    crowded = found.where("long").select(F.col("v").alias("key"), F.col("u").alias("fp"))
    sizes = scratch.table(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "crowded")
    if not sizes.limit(1).count():
        return short
    blocks = F.ceil(F.col("n") / posting_limit).cast("long")
    dealt = crowded.join(small(sizes), "key").select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("block"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block != other")
    # a key is below 2 ** 29, a block below 2 ** 17
    both = F.shiftleft("key", 34).bitwiseOR(F.shiftleft(F.least("block", "other"), 17)).bitwiseOR(F.greatest("block", "other"))
    return short.unionByName(scratch.table(sort(dealt.select(both.alias("key"), "fp")).mapInArrow(_posting_links(None), "u long, v long, long boolean"), "found-long").select("u", "v"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, posting_limit: int = 4096) -> DataFrame:
    """One row per input row: id, fp (signed 64-bit), component_id (the smallest id reachable by links, its own included).

    Texts are linked if their fingerprints differ in at most 4 bits. A null text counts as empty; texts
    without words have fingerprint 0 and are linked like any other. Rows without an id take part and never
    name a component that has another id. Rows that repeat are rows like others. An empty table gives an
    empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    docs = scratch.table(rows.mapInArrow(_fingerprints(width), f"id {kind}, fp long"), "docs")
    classes = scratch.table(docs.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    labels = components(scratch, links(scratch, classes.select("fp"), posting_limit))
    # most fingerprints are linked with no other
    linked = classes.join(labels, classes["fp"] == labels["node"]).select("fp", "first", "label")
    whole = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(whole, "label").select(F.col("fp").alias("of"), "component_id")
    named = classes.join(named, F.col("fp") == F.col("of"), "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    named = scratch.table(named, "named")
    scratch.keep("docs", "named")
    return split_join(docs, named, ["fp"], "n").select("id", "fp", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; rows that repeat that id stay together."""
    marked = Scratch(df.sparkSession, "near").table(near_copies(df, id_col, text_col, **how), "marked")
    gone = marked.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"))
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
