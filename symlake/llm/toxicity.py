"""Toxic passages by maximum-scoring segment search over token log-odds.

Training counts, over every labelled document of the training part, how often each word stands in toxic
and in clean documents. A word's features are the word itself and its prefixes (inflected terms share a
stem). A feature's score is its log-odds between the classes under a Dirichlet prior in proportion to its
overall rate; all features that are significant are kept, however many. Words that copies of one document
repeat always stand as far from the same word, so a toxic count is never above an estimate of the different
words `APART` places away; a term that stands in one phrase only, but in many documents, has many of them.

A token scores its best feature, any other token costs `drift`. A linear scan (Ruzzo and Tompa) finds all
maximal scoring segments of a text. Under clean text, segment scores S of n tokens follow an extreme-value
law with decay lambda, which solves sum p(s) exp(lambda s) = 1; a passage's evidence is lambda S - ln n
where positive, summed over passages. A logistic curve of its logarithm (plus 1), fitted to the training documents,
maps it to 0..1.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Scratch, release, small

#: Lengths of the prefixes that are features, in bytes of UTF-8.
PREFIXES = range(3, 10)
#: Words a worker remembers, words counted before they are passed on.
CACHE_WORDS, FLUSH_WORDS = 200_000, 200_000
#: How far away the word is that tells copies of a document from other documents; more than a phrase has.
APART = 16
#: Bins of evidence that the logistic curve is fitted to, for each power of e.
BINS = 40.0

_LETTERS = bytearray(b" " * 128) + bytearray(range(128, 256))
for _upper, _lower in zip(UPPER.encode(), LOWER.encode(), strict=True):
    _LETTERS[_upper] = _LETTERS[_lower] = _lower
_LETTERS = bytes(_LETTERS)


def tokens(text: bytes | None) -> list[bytes]:
    """Runs of letters: A-Z lower-cased, every byte of a non-ASCII character counting as a letter."""
    return (text or b"").translate(_LETTERS).split()


def features(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its proper prefixes."""
    return [word + b"$", *(word[:n] for n in PREFIXES if n < len(word))]


def held_out(id_col: str, folds: int, fold: int):
    """True for ids whose CRC-32 as text falls in the fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, clean, toxic, apart: counts by class and the hashed set of words APART places before it (after it, near the start) in toxic texts."""
    clean: dict[bytes, int] = {}
    toxic: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        words = list({**clean, **toxic})
        both = [toxic.get(w, (0, 0)) for w in words]
        columns = [pa.array([clean.get(w, 0) for w in words], pa.int64()), *(pa.array([r[k] for r in both], pa.int64()) for k in (0, 1))]
        found = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *columns], names=["word", "clean", "toxic", "apart"])
        clean.clear()
        toxic.clear()
        return found

    for batch in batches:
        for text, is_toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = tokens(text.as_py())
            if is_toxic:
                end = len(words) - 1
                for place, word in enumerate(words):
                    other = words[place - APART] if place >= APART else words[min(place + APART, end)]
                    row = toxic.get(word)
                    if row is None:
                        row = toxic[word] = [0, 0]
                    row[0] += 1
                    row[1] |= 1 << zlib.crc32(other) % 63
            else:
                for word in words:
                    clean[word] = clean.get(word, 0) + 1
            if len(clean) + len(toxic) > FLUSH_WORDS:
                yield out()
    if clean or toxic:
        yield out()
    release()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        own = [features(w) for w in words]
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays([pa.array([f for x in own for f in x], pa.binary()), *(batch.column(k).take(at) for k in (1, 2, 3))], names=["term", "clean", "toxic", "apart"])


def score_of(word: bytes, terms: dict[bytes, float]) -> float:
    """The best score of the word's features, 0 if none is in the model."""
    return max((terms[f] for f in features(word) if f in terms), default=0.0)


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text; scores: position and score above 0, in order.

    Every other position scores -drift. Each candidate keeps where the last one before it with a smaller sum on its
    left is; candidates that a search passes over are never passed again, so the scan is linear.
    """
    firsts, lasts, lows, highs, links = [], [], [], [], []  # lows, highs: sums before the first position and up to the last
    total, after = 0.0, 0
    for position, score in scores:
        low = total - drift * (position - after)
        total = high = low + score
        after, first, k = position + 1, position, len(lows) - 1
        while True:
            while k >= 0 and lows[k] >= low:
                k = links[k]
            if k < 0 or highs[k] >= high:
                break
            first, low, earlier = firsts[k], lows[k], links[k]
            for own in (firsts, lasts, lows, highs, links):
                del own[k:]
            k = earlier
        for own, value in zip((firsts, lasts, lows, highs, links), (first, position, low, high, k), strict=True):
            own.append(value)
    return [(a, b, high - low) for a, b, low, high in zip(firsts, lasts, lows, highs, strict=True)]


def decay(scores: np.ndarray, rates: np.ndarray) -> float:
    """The lambda > 0 at which sum rates * exp(lambda * scores) = 1; scores are negative on average."""
    low, high = 0.0, 1.0
    value = lambda x: float(np.sum(rates * np.exp(np.minimum(x * scores, 700.0)))) - 1.0
    while value(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def _scan(terms: dict[bytes, float], rate: float, drift: float):
    known: dict[bytes, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, starts, ends, parts, sizes = [], [], [], [], []
            for text in batch.column(1):
                words = tokens(text.as_py())
                try:
                    scores = [known[w] for w in words]
                except KeyError:
                    for w in set(words):
                        if w not in known:
                            known[w] = score_of(w, terms)
                    scores = [known[w] for w in words]
                    if len(known) > CACHE_WORDS:
                        known.clear()
                x, n = 0.0, 0
                for a, b, s in maximal_segments([(k, s) for k, s in enumerate(scores) if s], drift) if any(scores) else ():
                    if (more := rate * s - math.log(len(words))) > 0:
                        x, n = x + more, n + 1
                        starts.append(a)
                        ends.append(b + 1)
                        parts.append(more)
                evidence.append(x)
                sizes.append(n)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.float64())], names=["start", "end", "evidence"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(evidence, pa.float64()), spans, batch.column(3)], names=["id", "held_out", "evidence", "passages", "digest"])
        release()

    return run


def logistic(x: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope fitted to counts by Newton's method, the slope held small by a ridge."""
    a, b, scale = 0.0, 0.0, max(float(x.max(initial=1.0)), 1.0)
    z = np.stack([np.ones_like(x), x / scale])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * z[1], -30, 30)))
        gradient = z @ (positive - total * p) - np.array([0.01 * a, 0.01 * ridge * b])
        curve = (z * (total * p * (1 - p))) @ z.T + np.diag([0.01, 0.01 * ridge])
        step = np.linalg.solve(curve, gradient)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -50, 50))
        if np.abs(step).max() < 1e-9:
            break
    return a, b / scale


def terms_of(counted: DataFrame, clean: int, toxic: int, prior_share: float = 0.05, least_z: float = 3.0, least_odds: float = 2.0, least_contexts: int = 4) -> dict[bytes, float]:
    """The significant features (columns term, clean, toxic, apart) and their scores, all of them.

    The prior weighs as much as `prior_share` of all words. A count by hashed contexts that fills its 63 bins is
    not bounded by them.
    """
    prior = prior_share * (clean + toxic)
    bits = F.bit_count("apart")
    contexts = F.when(bits >= 62, F.lit(float("inf"))).otherwise(-63.0 * F.log(1 - bits / 63.0))
    one = F.least(F.col("toxic").cast("double"), contexts)
    alpha = prior * (F.col("clean") + F.col("toxic")) / (clean + toxic)
    odds = F.log((one + alpha) / (toxic + prior - one - alpha)) - F.log((F.col("clean") + alpha) / (clean + prior - F.col("clean") - alpha))
    spread = F.sqrt(1 / (one + alpha) + 1 / (F.col("clean") + alpha))
    scored = counted.where(bits >= least_contexts).select("term", odds.alias("odds"), (odds / spread).alias("z"))
    best = scored.where((F.col("z") >= least_z) & (F.col("odds") >= least_odds))
    return {bytes(r["term"]): float(r["odds"]) for r in best.collect()}


def _scored(terms: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[float, int] = {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n:
                    s = round(score_of(word, terms), 1)
                    totals[s] = totals.get(s, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.float64()), pa.array(list(totals.values()), pa.int64())], names=["score", "n"])

    return run


def detect(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, drift: float = 0.1,
) -> DataFrame:
    """One row per input row: id, held_out, evidence, passages (start, end in tokens, evidence), digest (MD5 of the text), score, predicted.

    The model is sent to every task; it has the significant features, of which there are far fewer than words.

    Labels are read for ids outside the fold only; of repeated labels of an id the largest counts, other
    values than 0 and 1 none. A null or empty text has no passages and the score of no evidence, which is
    the rate of toxic texts among such if nothing could be learned (0.5 without any label). Rows that repeat
    are rows like others. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "toxicity")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    marked = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND of IS NOT NULL")
    marked = scratch.table(marked.where(~held_out("of", folds, fold)).groupBy("of").agg(F.max("toxic").alias("toxic")), "marked")
    learn = rows.join(small(marked), F.col("id") == F.col("of")).select("text", "toxic")
    words = learn.mapInArrow(_count, "word binary, clean long, toxic long, apart long").groupBy("word")
    words = scratch.table(words.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("apart").alias("apart")), "words")
    clean, toxic = (int(x or 0) for x in words.agg(F.sum("clean"), F.sum("toxic")).first())
    terms: dict[bytes, float] = {}
    if clean and toxic:
        counted = words.mapInArrow(_features, "term binary, clean long, toxic long, apart long").groupBy("term")
        terms = terms_of(counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("apart").alias("apart")), clean, toxic)
    rate = 1.0
    if terms:
        bins = words.select("word", "clean").mapInArrow(_scored(terms), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
        scores = np.array([r["score"] or -drift for r in bins] + [max(terms.values())])
        rates = np.array([float(r["n"]) for r in bins] + [0.5])
        if (scores * rates).sum() < 0:
            rate = decay(scores, rates / rates.sum())
    held = rows.select("id", "text", held_out("id", folds, fold).alias("held_out"), _digest(F.col("text")).alias("digest"))
    kind = df.schema[id_col].dataType.simpleString()
    found = scratch.table(held.mapInArrow(_scan(terms, rate, drift), f"id {kind}, held_out boolean, evidence double, passages array<struct<start:int,end:int,evidence:double>>, digest binary"), "found")
    step = F.floor(F.log1p("evidence") * BINS).cast("int")
    scratch.keep("marked", "found")
    fit = found.where("NOT held_out").join(small(marked), F.col("id") == F.col("of")).groupBy(step.alias("bin")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"), F.avg(F.log1p("evidence")).alias("x")).collect()
    a, b = logistic(*(np.array([float(r[k]) for r in fit]) for k in ("x", "toxic", "n")))
    score = F.lit(1.0) / (1 + F.exp(-(F.lit(a) + F.lit(max(b, 0.0)) * F.log1p("evidence"))))
    return found.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows not predicted toxic, with all their columns. Rows are decided by id and text, so rows that share an id, or have none, go only for their own text."""
    found = detect(df, labels, id_col, text_col, **how).where("predicted = 1").select(F.col("id").alias("__id"), F.col("digest").alias("__gone"))
    found = Scratch(df.sparkSession, "clean").table(found.distinct(), "toxic")
    return df.join(small(found), F.col(id_col).eqNullSafe(F.col("__id")) & (_digest(F.col(text_col)) == F.col("__gone")), "left_anti")
