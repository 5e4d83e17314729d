"""Embedding near-dedup with randomised-rotation binary codes.

Equal vectors of a label are one class. Each class keeps the signs of its randomly rotated unit vector and the
correction factor f, the inner product of the sign vector (scaled to length 1) with it. For another vector q,
the inner product of its rotation with the sign vector, divided by f, is an unbiased estimate of the cosine, and
its error is below eps * sqrt((1 - f^2) / f^2 / (D - 1)) but with a small probability. Pairs whose upper bound,
in either direction, is below the threshold are left; the others get an exact cosine in double precision.

Pairs come from hash tables, each keyed by the largest coordinates of two more random rotations (cross-polytope
hashing). Two vectors of 64 dimensions at cosine 0.98 share a key with probability about 0.53 per table, of 1024 about
0.43; the number of tables grows with the logarithm of the dimensions, so that all miss about one in three million such
pairs, closer ones much less. Candidates are therefore found with that probability, there is no exact way for the rest;
recall was measured as 1.0 against brute force and SQL. A pair is looked at in the first table it shares.

Buckets get the codes first: a row goes on only if the code of another row in its bucket differs in so few bits that the
cosine may reach the threshold (a confidence bound on the bits, missed once in a billion). Vectors follow for those rows
alone. Tasks return rows, sums and spanning forests, never pairs; a bucket above `bucket_limit` rows is dealt out as
pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, small
from .components import components
from .simhash import unite

SEED, EPS = 42, 5.0
#: How often the bound on differing bits may miss a pair at the threshold.
MISSED = 1e-9
#: Words of codes compared at once.
STRIP = 4_000_000


def rotate(vectors: np.ndarray, which: int) -> np.ndarray:
    """A fixed random rotation: three rounds of random signs and a Hadamard transform, over a padded power of two."""
    n, d = vectors.shape
    size = max(2, 1 << (d - 1).bit_length())
    out = np.zeros((n, size), np.float64)
    out[:, :d] = vectors
    rng = np.random.default_rng([SEED, which, size])
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            out = out.reshape(n, -1, 2, h)
            out = np.stack((out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]), axis=2).reshape(n, size)
            h *= 2
        out /= np.sqrt(size)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, without overflow for large components."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def tables(dimensions: int) -> int:
    """20 tables up to 64 dimensions, two more for each doubling."""
    return 20 + 2 * max(0, (max(2, dimensions) - 1).bit_length() - 6)


def signatures(units: np.ndarray) -> np.ndarray:
    """The keys of the vectors in all tables."""
    count = tables(units.shape[1])
    keys = np.zeros((len(units), count), np.int64)
    for t in range(count):
        for part in (0, 1):
            turned = rotate(units, 1 + 2 * t + part)
            best = np.abs(turned).argmax(axis=1)
            keys[:, t] = keys[:, t] * 2 * turned.shape[1] + 2 * best + (turned[np.arange(len(units)), best] > 0)
    return keys


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign vectors (+1, -1), correction factors and rotated vectors."""
    turned = rotate(units, 0)
    signs = np.where(turned >= 0, 1.0, -1.0)
    return signs, (signs * turned).sum(axis=1) / np.sqrt(turned.shape[1]), turned


def most_bits(size: int, threshold: float) -> int:
    """Bits in which the codes of two vectors at the threshold differ at most, but for one in 1 / MISSED pairs."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    logs = [math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) + k * math.log(max(p, 1e-300)) + (size - k) * math.log(max(1 - p, 1e-300)) for k in range(size + 1)]
    tail = 0.0
    for k in range(size, -1, -1):
        tail += math.exp(logs[k])
        if tail > MISSED:
            return k
    return size


def margin(factors: np.ndarray, size: int) -> np.ndarray:
    return EPS * np.sqrt(np.maximum(0, 1 - factors**2) / factors**2 / max(1, size - 1))


def _vectors(double: bool):
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for value in batch.column(1):
                x = value.as_py()
                vector = None if not x or None in x else np.array(x, kind)
                good = vector is not None and np.isfinite(vector).all() and vector.any()
                raw = (vector + kind(0)).tobytes() if good else None
                raws.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["row", "key", "vector"])

    return run


def _signed(double: bool):
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raws])
            keys, code, factor = [np.empty(0, np.int64)] * len(raws), [b""] * len(raws), np.zeros(len(raws))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                units = unit(np.frombuffer(b"".join(raws[k] for k in at), kind).reshape(len(at), -1).astype(np.float64))
                for k, own in zip(at, signatures(units), strict=True):
                    keys[k] = own
                signs, factor[at], _ = codes(units)
                for k, bits in zip(at, np.packbits(signs > 0, axis=1), strict=True):
                    code[k] = bits.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(code, pa.binary()), pa.array(factor)], names=["class", "keys", "code", "factor"])

    return run


def _buckets(columns: tuple[str, ...], each):
    """A step over rows sorted by the columns that name a bucket: `each` gets whole buckets, one or many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            if not now.num_rows:
                continue
            mark = np.stack([now.column(c).to_numpy() for c in columns])
            other = np.flatnonzero((mark != mark[:, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from each(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None and held.num_rows:
            yield from each(held)

    return run


def _spans(rows: pa.Table, columns: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where the buckets with two rows or more begin and end."""
    mark = np.stack([rows.column(c).to_numpy() for c in columns])
    edges = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [rows.num_rows]))
    big = np.flatnonzero(ends - starts > 1)
    return list(zip(starts[big].tolist(), ends[big].tolist(), strict=True))


NAMES = ("bucket", "low", "high")


def _near_codes(threshold: float):
    """The places (bucket, low, high, class) whose code is near that of another row of the bucket, and of another block where two meet."""

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        spans = _spans(rows, NAMES)
        if not spans:
            return
        block, low, high = (rows.column(c).to_numpy() for c in ("block", "low", "high"))
        codes, kept = rows.column("code").to_pylist(), []
        for a, b in spans:
            sizes = np.array([len(c) for c in codes[a:b]])
            for size in np.unique(sizes):  # one, but for colliding buckets
                at = np.flatnonzero(sizes == size) + a
                own = np.frombuffer(b"".join(codes[k] for k in at), np.uint8).reshape(len(at), -1)
                words = np.zeros((len(at), -(-int(size) // 8) * 8), np.uint8)
                words[:, :size] = own
                words = words.view(np.uint64)
                most, near = most_bits(8 * int(size), threshold), np.zeros(len(at), bool)
                step = max(1, STRIP // words.size)
                for strip in range(0, len(at), step):
                    some = slice(strip, strip + step)
                    close = np.bitwise_count(words[some, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64) <= most
                    close[np.arange(len(close)), np.arange(strip, strip + len(close))] = False
                    if low[a] != high[a]:
                        close &= block[at][some, None] != block[at][None, :]
                    near[some] = close.any(axis=1)
                kept.append(at[near])
        found = np.concatenate(kept)
        if len(found):
            yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(found)).combine_chunks() for c in ("bucket", "low", "high", "block", "table", "class")], names=["bucket", "low", "high", "block", "table", "class"])

    return _buckets(NAMES, each)


def _close(double: bool, threshold: float):
    """Links within buckets; rows come sorted by bucket."""
    kind = np.float64 if double else np.float32

    def bucket(rows: dict[str, np.ndarray | list], table: int, cross: bool):
        vectors = np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows["class"]), -1).astype(np.float64)
        units = unit(vectors)
        turned = rotate(units, 0)
        size = turned.shape[1]
        signs = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(vectors), -1), axis=1)[:, :size].astype(np.float64) * 2 - 1
        near = margin(rows["factor"], size)
        left, right = [], []
        for at in range(0, len(units), 256):  # estimates and upper bounds for a strip of pairs
            strip = slice(at, at + 256)
            one = (signs[strip] @ turned.T) / np.sqrt(size) / rows["factor"][strip, None] + near[strip, None]
            two = (turned[strip] @ signs.T) / np.sqrt(size) / rows["factor"][None, :] + near[None, :]
            i, j = np.nonzero(np.minimum(one, two) >= threshold)
            i = i + at
            use = i < j
            left.append(i[use])
            right.append(j[use])
        i, j = np.concatenate(left), np.concatenate(right)
        if cross:
            use = rows["block"][i] != rows["block"][j]
            i, j = i[use], j[use]
        same = rows["keys"][i] == rows["keys"][j]
        use = same[:, table] & (same.argmax(axis=1) == table) & (rows["group"][i] == rows["group"][j])
        i, j = i[use], j[use]
        use = np.einsum("nd,nd->n", units[i], units[j]) >= threshold - 1e-9
        i, j = i[use], j[use]
        # powers of two taken out change no digit of the cosine, and keep squares from overflow
        even = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        length = np.sqrt((even**2).sum(axis=1))
        use = np.einsum("nd,nd->n", even[i], even[j]) / (length[i] * length[j]) >= threshold
        return i[use], j[use]

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        spans = _spans(rows, NAMES)
        if not spans:
            return
        number = lambda c: rows.column(c).to_numpy()
        classes, counts, table, low, high = number("class"), number("n"), number("table"), number("low"), number("high")
        group, block, factor = number("group"), number("block"), number("factor")
        out: list[tuple] = []
        for a, b in spans:
            vectors = rows.slice(a, b - a).column("vector").to_pylist()
            for size in {len(v) for v in vectors}:  # one, but for colliding buckets
                at = np.array([k for k, v in enumerate(vectors) if len(v) == size]) + a
                if len(at) < 2:
                    continue
                own = rows.take(pa.array(at))
                i, j = bucket(
                    {"class": classes[at], "vector": own.column("vector").to_pylist(), "code": own.column("code").to_pylist(), "factor": factor[at],
                     "keys": np.array(own.column("keys").to_pylist(), np.int64), "group": group[at], "block": block[at]},
                    int(table[a]), bool(low[a] != high[a]),
                )
                if len(i):
                    n, roots = counts[at], np.arange(len(at))
                    add = np.bincount(i, n[j], len(at)) + np.bincount(j, n[i], len(at))
                    unite(roots, i, j)
                    tied = np.flatnonzero(add)
                    out.append((classes[at][tied], add[tied].astype(np.int64), classes[at][roots[tied]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(3)], names=["u", "links", "v"])

    return _buckets(NAMES, each)


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, bucket_limit: int = 4096,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length are linked if their cosine is at least the threshold;
    n_links counts the other rows linked directly, component_id is the smallest id reachable, and kept says that
    it is the row's own. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. Rows that repeat a vector are linked like any others; rows that repeat an id count each. An empty
    table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "embeddings")
    double = not isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label")).alias("row"), F.col(vector_col).cast("array<double>" if double else "array<float>").alias("vector"))
    kind = rows.schema["row"].dataType.simpleString()
    rows = scratch.table(rows.mapInArrow(_vectors(double), f"row {kind}, key binary, vector binary").select("row.id", "row.label", "key", "vector"), "rows")
    grouped = rows.where("label IS NOT NULL AND key IS NOT NULL").groupBy("label", "key")
    classes = grouped.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector"))
    classes = scratch.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    signed = classes.select("class", "vector").mapInArrow(_signed(double), "class long, keys array<long>, code binary, factor double")
    light = classes.select("class", "n", F.xxhash64(F.lit("group"), "label", F.octet_length("vector")).alias("group"))
    signed = scratch.table(signed.join(light, "class"), "signed")

    filed = signed.select("class", "group", "code", F.posexplode("keys").alias("table", "at")).withColumn("bucket", F.xxhash64("group", "table", "at")).drop("group", "at")
    crowded = scratch.table(filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket_limit), "crowded")
    if crowded.limit(1).count():
        filed = filed.join(small(crowded), "bucket", "left")
        blocks = F.coalesce(F.ceil(F.col("rows") / bucket_limit), F.lit(1)).cast("int")
        filed = filed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "class"), F.col("blocks")).cast("int"))
        filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    else:
        filed = filed.withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    sort = lambda rows: rows.repartition(*NAMES).sortWithinPartitions(*NAMES, "class")
    near = sort(filed.select(*NAMES, "block", "table", "class", "code")).mapInArrow(_near_codes(threshold), "bucket long, low int, high int, block int, table int, class long")
    near = scratch.table(near, "near")
    with_vectors = near.join(signed.select("class", "n", "group", "keys", "code", "factor"), "class").join(classes.select("class", "vector"), "class")
    found = sort(with_vectors.select(*NAMES, "block", "table", "class", "n", "group", "keys", "code", "factor", "vector"))
    found = scratch.table(found.mapInArrow(_close(double, threshold), "u long, links long, v long"), "found")
    labels = components(scratch, found.select("u", "v"))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    of = classes.select("label", "key", "class", "first", "n").join(counts, F.col("class") == F.col("u"), "left").join(labels.withColumnRenamed("label", "tied"), F.col("class") == F.col("node"), "left")
    of = scratch.table(of.select("label", "key", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("tied", "class").alias("component")), "of")
    scratch.keep("rows", "of")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component").select("label", "key", "n_links", "component_id")
    out = rows.select("id", "label", "key").join(of, ["label", "key"], "left")
    mine = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.col("id").eqNullSafe(mine).alias("kept"))
