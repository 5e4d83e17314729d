"""Near copies by SimHash, verified by exact Jaccard similarity, and completed where SimHash gives no guarantee.

SimHash links (byte-position inverted index, simhash.links) over shingles of five words find the closest copies;
each is verified by the exact similarity of the shingle sets. Texts of similarity 0.8 differ in about ten of 64
bits, so that they need not share any byte at the same position: an index by bytes alone would miss nearly all of
them. What it leaves is found by prefix filtering: texts whose sets have a Jaccard similarity of at least 4/5 share
one of the first n - ceil(4n/5) + 1 members of each set in any order common to all sets, so lists by these members
hold every such pair. The order puts shingles last that are frequent in a bounded sample of texts; then the lists are
counted, and the shingles of long lists are put last too, for which only the rows in them are filed anew (the others keep
their place in the common order). The order decides the length of the lists, never the result. A pair is left if verified links connect it already, or if the sizes or the
parities of bins of shingles rule it out (odd sketches: two sets differ at least in as many members as bins), first
those of 256 bins, then of two to four bins for each shingle. All others are decided by the intersection.

A list that is still over `limit` rows, as those of large groups of near copies, is first tied to a few of its rows;
only its pairs that are not connected after that are compared, each in one of the lists that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import Scratch, lowered, one_of_each, release, small
from .components import components

#: The least similarity as a fraction.
NUM, DEN = 4, 5
#: Texts sampled for the order, shingles put last at most, rows that a long list is tied to, parts of a long list.
SAMPLE, FREQUENT, CENTRES, PARTS = 8000, 100_000, 8, 16
#: How often long lists are counted and their rows filed anew.
REFINED = 2
#: Rows of a table that the driver may broadcast to find their texts, and bits that a larger table is told by first.
TOLD, BITS = 100_000, 1 << 24


def shingles(text: bytes | None, width: int) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of a text's shingles and its fingerprint; a text without words has the hash of the empty shingle and 0."""
    joined, starts, ends = simhash.spans(text, width)
    found = simhash.hashes(joined, starts, ends)
    return np.unique(found), simhash.majority(found) if joined else 0


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingles(t.as_py(), width)[0].view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "set"])
        release()

    return run


def _parity(members: np.ndarray, bins: int) -> np.ndarray:
    """Bits that tell of each bin (by the lowest bits of the members) whether it has an odd number of them, as 64-bit words."""
    odd = np.bincount((members & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(width: int, frequent: np.ndarray, counts: np.ndarray):
    """row, id and digest as given, size, the fingerprint, the odd sketches and the shingles that the row is filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sizes, fps, sketches, parities, keys = [], [], [], [], []
                for text in some.column(3):
                    own, fp = shingles(text.as_py(), width)
                    n, often = len(own), np.zeros(len(own))
                    if len(frequent):
                        where = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        often = np.where(frequent[where] == own, counts[where], 0.0)
                    keys.append(own[np.lexsort((own, often))[: n + 1 - -(-NUM * n // DEN)]].view(np.int64))
                    sketches.append(_parity(own >> np.uint64(56), 256))
                    parities.append(_parity(own, max(256, 1 << (2 * n - 1).bit_length())))
                    sizes.append(n)
                    fps.append(fp)
                words = np.array(sketches, np.int64).reshape(-1, 4)
                columns = [*some.columns[:3], pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), *(pa.array(words[:, k]) for k in range(4)), pa.array(parities, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "digest", "size", "fp", "s0", "s1", "s2", "s3", "parity", "keys"])
        release()

    return run


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def _candidates(limit: int):
    """Of postings (key, row, size) sorted by key and row: pairs u < v, and with v null the key and rows of long lists."""

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack([u, v], axis=1), axis=0)
        columns = [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v", "key", "size"])

    def rest(key: int, rows: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.array(np.full(len(rows), key)), pa.array(sizes)]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v", "key", "size"])

    def tied(rows: np.ndarray, sizes: np.ndarray, centres: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        u, v = np.repeat(centres[0], len(rows)), np.tile(rows, len(centres[0]))
        use = (u < v) & _fit(np.repeat(centres[1], len(rows)), np.tile(sizes, len(centres[0])))
        return out(u[use], v[use])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, sizes, overlong, centres = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None, None

        def begun(k: np.ndarray, r: np.ndarray, s: np.ndarray):
            own = (r[:CENTRES], s[:CENTRES])
            return own, [rest(k[0], r, s), tied(r, s, own)]

        def done(k: np.ndarray, r: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, first, counts = np.unique(k, return_index=True, return_counts=True)
            for at, n in zip(first[counts > limit].tolist(), counts[counts > limit].tolist(), strict=True):
                yield from begun(k[at : at + n], r[at : at + n], s[at : at + n])[1]
            use = np.repeat((counts > 1) & (counts <= limit), counts)
            k, r, s = k[use], r[use], s[use]
            ends, at, found = np.searchsorted(k, k, side="right"), np.arange(len(k)), []
            for step in range(1, limit):
                at = at[at + step < ends[at]]
                if not len(at):
                    break
                near = at[_fit(s[at], s[at + step])]
                found.append((r[near], r[near + step]))
            if found:
                yield out(*(np.concatenate(x) for x in zip(*found, strict=True)))

        for batch in batches:
            k, r, s = (batch.column(c).to_numpy() for c in range(3))
            if overlong is not None:  # the rest of a long list
                same = int(np.searchsorted(k, overlong, side="right"))
                if same:
                    yield rest(overlong, r[:same], s[:same])
                    yield tied(r[:same], s[:same], centres)
                k, r, s = k[same:], r[same:], s[same:]
                if not len(k):
                    continue
                overlong = None
            keys, rows, sizes = np.concatenate((keys, k)), np.concatenate((rows, r)), np.concatenate((sizes, s))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from done(keys[:last], rows[:last], sizes[:last])
            keys, rows, sizes = keys[last:], rows[last:], sizes[last:]
            if len(keys) > limit:
                overlong = keys[0]
                centres, ready = begun(keys, rows, sizes)
                yield from ready
                keys, rows, sizes = keys[:0], rows[:0], sizes[:0]
        yield from done(keys, rows, sizes)

    return run


def _allowed(differ: Column, a: str, b: str) -> Column:
    """Whether sets that differ in so many members at least can be similar."""
    return differ * (NUM + DEN) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (DEN - NUM)


def _possible(a: str, b: str) -> Column:
    """Whether the sizes and small sketches of a and b allow the similarity."""
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(4)), F.lit(0))
    return (F.least(f"{a}.size", f"{b}.size") * DEN >= F.greatest(f"{a}.size", f"{b}.size") * NUM) & _allowed(differ, a, b)


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two large sketches differ; of sizes that may be similar one has twice the bins at most, and is folded."""
    words = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.when(F.size(x) == words, x).otherwise(F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), xor))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda n, x: n + x)


def _marked(scratch: Scratch, rows: DataFrame, digest: str, wanted: DataFrame, name: str) -> DataFrame:
    """The rows with __told, which is true of all whose digest is in wanted (is) and of few others; the table of bits has BITS / 64 rows at most."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = wanted.select(bit("is").alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int"))).alias("__bits"))
    words = scratch.table(words, name)
    placed = rows.withColumn("__bit", bit(digest)).withColumn("__word", F.shiftright("__bit", 6)).join(F.broadcast(words), "__word", "left")
    told = F.coalesce(F.getbit("__bits", F.col("__bit").bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return placed.withColumn("__told", told).drop("__bit", "__word", "__bits")


def _few(df: DataFrame) -> bool:
    return df.limit(TOLD + 1).count() <= TOLD


def _of(scratch: Scratch, texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The texts (id, digest, text) with the rows of wanted (of, is) that they belong to; of a large table only the texts that it may want are shuffled."""
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("is"))
    if _few(wanted):
        return texts.join(F.broadcast(wanted), same)
    return _marked(scratch, texts, "digest", wanted, name).where("__told").drop("__told").join(wanted, same)


def _similar(scratch: Scratch, texts: DataFrame, filed: DataFrame, pairs: DataFrame, width: int, name: str) -> DataFrame:
    """The pairs (u, v) whose sets are similar; texts: id, digest, text."""
    own = filed.select("row", "size", "parity")
    near = pairs.join(own.alias("a"), F.col("u") == F.col("a.row")).join(own.alias("b"), F.col("v") == F.col("b.row"))
    pairs = scratch.table(near.where(_allowed(_bits_apart(F.col("a.parity"), F.col("b.parity")), "a", "b")).select("u", "v"), f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    wanted = scratch.table(filed.select("row", F.col("id").alias("of"), F.col("digest").alias("is")).join(wanted, "row", "left_semi"), f"{name}-wanted")
    found = _of(scratch, texts, wanted, f"{name}-bits").select("row", "text")
    # rows that repeat id and text give the same set
    sets = scratch.table(found.mapInArrow(_sets(width), "row long, set array<long>").groupBy("row").agg(F.any_value("set").alias("set")), f"{name}-sets")
    both = pairs.join(sets.select(F.col("row").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("row").alias("v"), F.col("set").alias("b")), "v")
    similar = both.where(F.size(F.array_intersect("a", "b")) * (NUM + DEN) >= (F.size("a") + F.size("b")) * NUM).select("u", "v")
    similar = scratch.table(similar, name)
    scratch.drop(f"{name}-sets", f"{name}-pairs", f"{name}-wanted", f"{name}-bits")
    return similar


def _simhash_links(scratch: Scratch, texts: DataFrame, filed: DataFrame, width: int) -> DataFrame:
    """Verified links of rows whose fingerprints are equal or linked; fewer than rows."""
    classes = scratch.table(filed.groupBy("fp").agg(F.min("row").alias("first")), "classes")
    equal = filed.join(classes, "fp").where("row != first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    linked = simhash.links(scratch, classes.select("fp")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    ends = linked.join(classes.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = equal.unionByName(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))).distinct()
    light = filed.drop("parity", "id", "digest")
    near = pairs.join(light.alias("a"), F.col("u") == F.col("a.row")).join(light.alias("b"), F.col("v") == F.col("b.row"))
    pairs = scratch.table(near.where(_possible("a", "b")).select("u", "v"), "close-pairs")
    return _similar(scratch, texts, filed, pairs, width, "close-similar")


def file(scratch: Scratch, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """One row per row of texts (id, digest, text): row (a number), id, digest, size, fingerprint, sketches and the shingles it is filed under.

    Also the shingles (key) that come last in the order, with about how many texts (n) have them.
    """
    total = texts.count()
    part = texts.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))))
    sampled = part.select(F.lit(0).cast("long").alias("row"), "text").mapInArrow(_sets(width), "row long, set array<long>").select(F.explode("set").alias("key"))
    often = sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT)
    frequent = scratch.table(often.select("key", (F.col("n") * max(1.0, total / SAMPLE)).alias("n")), "frequent")
    shape = f"row long, id {texts.schema['id'].dataType.simpleString()}, digest binary, size long, fp long, s0 long, s1 long, s2 long, s3 long, parity array<long>, keys array<long>"
    # written once, since all uses must see the same row numbers
    return scratch.table(texts.select(F.monotonically_increasing_id().alias("row"), "id", "digest", "text").mapInArrow(_prefixes(width, *_order(frequent)), shape), "filed"), frequent


def _order(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that come last, and how many texts about have them."""
    found = frequent.toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column(1).to_numpy()[order]


def _longest(lists: DataFrame) -> DataFrame:
    """Of lists (key, n) about FREQUENT of the longest at most; the driver sees only how many lists have which length."""
    lengths, before = lists.groupBy("n").agg(F.count(F.lit(1)).alias("lists")).orderBy(F.desc("n")).toArrow(), 0
    for n, count in zip(lengths.column(0).to_pylist(), lengths.column(1).to_pylist(), strict=True):
        if before + count > FREQUENT:
            share = int((FREQUENT - before) / count * (1 << 30))
            return lists.where((F.col("n") > n) | ((F.col("n") == n) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share)))
        before += count
    return lists


def refine(scratch: Scratch, texts: DataFrame, filed: DataFrame, frequent: DataFrame, width: int, limit: int) -> DataFrame:
    """The table with rows in long lists filed anew, those lists' shingles being put last; about FREQUENT of the longest lists at most."""
    for turn in range(REFINED):
        lists = filed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        lists = scratch.table(lists.join(frequent.select("key"), "key", "left_anti"), f"counted-{turn}")
        keys = scratch.table(_longest(lists).select("key", F.col("n").cast("double").alias("n")), f"long-{turn}")
        if not keys.limit(1).count():
            break
        frequent = scratch.table(frequent.unionByName(keys), f"frequent-{turn}")
        rows = filed.select("row", F.explode("keys").alias("key")).join(F.broadcast(keys.select("key")), "key", "left_semi").select("row").distinct()
        rows = scratch.table(filed.select("row", F.col("id").alias("of"), F.col("digest").alias("is")).join(rows, "row", "left_semi"), f"again-{turn}")
        found = _of(scratch, texts, rows, f"again-bits-{turn}").select("row", "id", "digest", "text")
        shape = ", ".join(f"{c} {kind}" for c, kind in filed.dtypes)
        new = found.mapInArrow(_prefixes(width, *_order(frequent)), shape)
        # rows that repeat id and text are filed alike
        new = new.groupBy("row").agg(F.any_value(F.struct(*filed.columns[1:])).alias("r")).select("row", "r.*")
        filed = scratch.table(filed.join(small(rows.select("row"), TOLD), "row", "left_anti").unionByName(new), f"filed-{turn}")
    return filed


def links(scratch: Scratch, texts: DataFrame, filed: DataFrame, width: int, limit: int = 64) -> DataFrame:
    """Links u, v of rows of filed (one per text) that join every two of the least similarity, directly or by other such links."""
    close = _simhash_links(scratch, texts, filed.drop("keys"), width)
    sketches = filed.drop("keys", "parity", "fp", "id", "digest").join(components(scratch, close, "close"), F.col("row") == F.col("node"), "left").withColumn("label", F.coalesce("label", "row")).drop("node")
    postings = filed.select(F.explode("keys").alias("key"), "row", "size").repartition("key").sortWithinPartitions("key", "row")
    found = scratch.table(postings.mapInArrow(_candidates(limit), "u long, v long, key long, size long"), "candidates")
    pairs = found.where("v IS NOT NULL").select("u", "v").distinct()
    near = pairs.join(sketches.alias("a"), F.col("u") == F.col("a.row")).join(sketches.alias("b"), F.col("v") == F.col("b.row"))
    pairs = scratch.table(near.where((F.col("a.label") != F.col("b.label")) & _possible("a", "b")).select("u", "v"), "pairs")
    tied = close.unionByName(_similar(scratch, texts, filed, pairs, width, "similar"))
    lists = found.where("v IS NULL").select("key", F.col("u").alias("row"))
    if not lists.limit(1).count():
        return tied
    # rows of long lists by what they are connected to; the largest part of a list needs no comparison with itself
    labels = components(scratch, tied, "tied")
    sketches = filed.drop("keys", "parity", "fp", "id", "digest")
    lists = lists.join(labels, F.col("row") == F.col("node"), "left").select("key", "row", F.coalesce("label", "row").alias("label"))
    parts = scratch.table(lists.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")), "parts")
    most = parts.groupBy("key").agg(F.max_by("label", "n").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lists = scratch.table(lists.join(most, "key").join(sketches, "row"), "lists")
    # of the long lists that two rows share the one with the smallest key compares them
    lists = lists.join(lists.groupBy("row").agg(F.collect_set("key").alias("own")), "row")
    # the smaller side goes to all parts; rows made so do not count in the planner's sizes, so it must not choose a broadcast
    one = lists.where("label != most").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")
    other = lists.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part"))
    first = F.array_min(F.array_intersect("a.own", "b.own")) == F.col("a.key")
    more = one.alias("a").join(other.alias("b"), same & (F.col("a.label") != F.col("b.label")) & _possible("a", "b") & first)
    more = scratch.table(more.select(F.least("a.row", "b.row").alias("u"), F.greatest("a.row", "b.row").alias("v")).distinct(), "more")
    return tied.unionByName(_similar(scratch, texts, filed, more, width, "more-similar"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, limit: int = 64) -> DataFrame:
    """The row with the smallest id (null last) of each component of similar texts, with all its columns.

    Texts are linked if their sets of shingles of `width` words have a Jaccard similarity of at least 4/5. Words are
    folded and separated as in simhash.fingerprint; a shorter text is one shingle; a null text and texts without words
    equal each other. Rows are decided by id and text, so rows that share an id, or have none, go only for their own
    text; of different texts with the smallest id that of an earlier row stays, and of rows that repeat id and text the
    earliest. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "near-sets")
    digest = F.unhex(F.md5(lowered(F.col(text_col)).cast("binary")))
    texts = df.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).cast("binary").alias("text"))
    filed, frequent = file(scratch, texts, width)
    reps = filed.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    reps = scratch.table(reps, "reps")
    copied = reps.where("n > 1").limit(1).count() > 0
    nodes = scratch.table(filed.join(reps.select("first.row"), "row", "left_semi"), "nodes") if copied else filed
    nodes = refine(scratch, texts, nodes, frequent, width, limit)
    labels = components(scratch, links(scratch, texts, nodes, width, limit))
    own = reps.join(labels, F.col("first.row") == F.col("node"), "left").where("node IS NOT NULL OR n > 1").select("digest", "first", F.coalesce("label", "first.row").alias("label"))
    own = scratch.table(own, "own")
    kept = own.groupBy("label").agg(F.min(F.struct("first", "digest")).alias("best"))
    decided = own.join(kept, "label").select("digest", F.col("best.first.id").alias("keep"), F.col("best.digest").alias("kept"))
    rows = filed.select("id", "digest").join(decided, "digest")
    gone = rows.where(~(F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("kept")))).select(F.col("id").alias("__id"), F.col("digest").alias("__gone"))
    gone = scratch.table(gone.distinct(), "gone")
    scratch.keep("filed", "gone")
    keyed = df.withColumn("__digest", digest)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__gone"))
    if _few(gone):
        stay = keyed.join(F.broadcast(gone), same, "left_anti")
    else:
        told = _marked(scratch, keyed, "__digest", gone.select(F.col("__gone").alias("is")), "gone-bits")
        stay = told.where("NOT __told").unionByName(told.where("__told").join(gone, same, "left_anti")).drop("__told")
    return (one_of_each(stay, [id_col, "__digest"], filed.select(F.col("id").alias(id_col), F.col("digest").alias("__digest"))) if copied else stay).select(*df.columns)
