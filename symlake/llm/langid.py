"""Language of texts, which may switch between languages, by a linear-chain conditional random field.

Every word is labelled: its features are the word itself (lexicon), its affixes and its byte n-grams, hashed
to a fixed table of weights; transitions between the labels of neighbouring words are learned too. A run of
letters without spaces, as some scripts write, is cut into short pieces one after another, each a word of the
chain. Marginals come from forward-backward over the whole text, for many texts at a time. A text's language is
the label with the largest sum of marginals.

The model is fitted on a bounded sample: about `train_docs` texts, dealt evenly to all languages by a hash of id
and text (`LEAST_DOCS` of a language if there are many), and of each a window of `train_chars` characters whose
place is hashed too. Half of the training chains are spliced from several texts, so that switches are learned.
Prediction reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import release
from .toxicity import held_out, tokens

BITS = 17
#: Texts of a language to learn from at least, if it has so many.
LEAST_DOCS = 20
#: Numbers (words by labels) that a worker remembers emissions in, and numbers in one run of forward-backward (one text at least).
CACHE_CELLS, CHAIN_CELLS = 2_000_000, 2_500_000
#: Longest word of a chain in bytes, and characters in a piece of a script that puts no spaces between words.
LONGEST, PIECE = 40, 3
_MASK = (1 << BITS) - 1


#: Bytes that only texts with letters outside the Latin, Greek, Cyrillic and like alphabets, or with non-ASCII signs, have.
_ODD = re.compile(rb"[\xc2\xcc\xcd\xe0-\xff]")
#: Scripts that put no spaces between words, and runs of letters (with their marks) of such a script or of others.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_RUNS = regex.compile(rf"(?P<unspaced>[{_UNSPACED}][{_UNSPACED}\p{{M}}]*)|(?:(?![{_UNSPACED}])[\p{{L}}\p{{M}}])+")


@lru_cache(20_000)
def pieces(token: bytes) -> tuple[bytes, ...]:
    """The words of a token: runs of letters of one kind, cut one after another where they are long or a script has no spaces."""
    found = []
    for match in _RUNS.finditer(token.decode("utf-8", "replace")):
        run = match.group()
        step = PIECE if match["unspaced"] else LONGEST // 4 if len(run.encode()) > LONGEST else len(run)
        found += [run[at : at + step].encode() for at in range(0, len(run), step)]
    return tuple(found)


def words(text: bytes | None) -> list[bytes]:
    """The words of the chain: all letters of the text belong to one."""
    own = tokens(text)
    if own and (_ODD.search(text) or max(map(len, own)) > LONGEST):
        return [p for w in own for p in (pieces(w) if len(w) > LONGEST or _ODD.search(w) else (w,))]
    return own


def word_features(word: bytes) -> list[int]:
    """Hashed lexicon, affix and n-gram features."""
    crc, padded = zlib.crc32, b"<" + word + b">"
    found = [crc(b"w" + word)]
    found += [crc(b"p" + word[:n]) for n in (2, 3, 4) if n < len(word)]
    found += [crc(b"s" + word[-n:]) for n in (2, 3, 4) if n < len(word)]
    found += [crc(padded[k : k + 2]) for k in range(len(padded) - 1)]
    found += [crc(padded[k : k + 3]) for k in range(len(padded) - 2)]
    return [f & _MASK for f in found]


def chains(psi: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains that lie one after another in psi (potentials of words by labels, above 0).

    start and move are potentials too. Returns the marginals of all words, the forward and the backward values,
    each word's scaled to sum 1. Chains without words are allowed.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    forward, backward = np.empty_like(psi), np.empty_like(psi)
    for t in range(longest):
        m = active[t]
        at = first[:m] + t
        now = psi[at] * (start if t == 0 else forward[at - 1] @ move)
        forward[at] = now / now.sum(axis=1, keepdims=True)
    back = move.T
    for t in range(longest - 1, -1, -1):
        m = active[t]
        more = active[t + 1] if t + 1 < longest else 0
        at = first[:m] + t
        if m > more:
            backward[at[more:]] = 1.0 / psi.shape[1]
        if more:
            up = at[:more] + 1
            now = (psi[up] * backward[up]) @ back
            backward[at[:more]] = now / now.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward


class Model:
    """labels, weights (2 ** BITS by labels), start and move (log potentials)."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)), np.float32)
        self.start = np.zeros(len(labels), np.float32)
        self.move = np.zeros((len(labels), len(labels)), np.float32)

    def potentials(self, logs: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(logs - logs.max(axis=1, keepdims=True), -30, 0))

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of starts and transitions; like those of words none is so small that products vanish."""
        return tuple(np.exp(np.clip(x.astype(np.float64) - x.max(), -20, 0)) for x in (self.start, self.move))

    def emissions(self, new: list[bytes]) -> np.ndarray:
        if not new:
            return np.zeros((0, len(self.labels)), np.float32)
        own = [word_features(w) for w in new]
        flat = np.array([f for x in own for f in x], np.int64)
        return np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum([len(x) for x in own])[:-1])), axis=0)


def fit(texts: list[tuple[bytes, str]], rounds: int = 4, chain: int = 48, batch: int = 200, rate: float = 0.3, ridge: float = 1e-6, seed: int = 7) -> Model:
    """The model of labelled texts: AdaGrad steps on the conditional likelihood of chains of `chain` words."""
    model = Model(sorted({lang for _, lang in texts}))
    if not model.labels:
        return model
    rng, number = np.random.default_rng(seed), {lang: k for k, lang in enumerate(model.labels)}
    vocabulary: dict[bytes, int] = {}
    runs: list[tuple[np.ndarray, int]] = []
    for text, lang in texts:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], np.int64)
        runs += [(ids[at : at + chain], number[lang]) for at in range(0, len(ids), chain)]
    if not runs:
        return model
    own = [np.array(word_features(w), np.int64) for w in vocabulary]
    flat, sizes = np.concatenate(own), np.array([len(x) for x in own])
    begin = np.cumsum(sizes) - sizes
    k = len(model.labels)
    seen = [np.full(x.shape, 1e-3, np.float64) for x in (model.weights, model.start, model.move)]
    for _ in range(rounds):
        order = rng.permutation(len(runs))
        for at in range(0, len(order), batch):
            ids, gold, lengths = [], [], []
            for n, r in enumerate(order[at : at + batch]):
                parts = [runs[r]]
                if n % 2:  # a chain that switches
                    parts = [(x[a : a + size], y) for x, y in (runs[r], *(runs[q] for q in rng.integers(0, len(runs), 2))) for size in (int(rng.integers(4, 20)),) for a in (int(rng.integers(0, max(1, len(x) - size))),)]
                ids += [x for x, _ in parts]
                gold += [np.full(len(x), y) for x, y in parts]
                lengths.append(sum(len(x) for x, _ in parts))
            chained, gold, lengths = np.concatenate(ids), np.concatenate(gold), np.array(lengths)
            unique, where = np.unique(chained, return_inverse=True)
            spans = np.repeat(begin[unique] - np.concatenate(([0], np.cumsum(sizes[unique])[:-1])), sizes[unique]) + np.arange(sizes[unique].sum())
            features, owner = flat[spans], np.repeat(np.arange(len(unique)), sizes[unique])
            logs = np.add.reduceat(model.weights[features], np.concatenate(([0], np.cumsum(sizes[unique])[:-1])), axis=0)
            psi = model.potentials(logs)[where].astype(np.float64)
            start, move = model.steps()
            marginal, forward, backward = chains(psi, lengths, start, move)
            slope = -marginal
            slope[np.arange(len(gold)), gold] += 1
            ends = np.cumsum(lengths)
            heads = (ends - lengths)[lengths > 0]
            inner = np.setdiff1d(np.arange(len(gold)), heads)
            pair = forward[inner - 1][:, :, None] * move[None] * (psi[inner] * backward[inner])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moved = -pair.sum(axis=0)
            np.add.at(moved, (gold[inner - 1], gold[inner]), 1)
            per_word = np.stack([np.bincount(where, slope[:, c], len(unique)) for c in range(k)], axis=1)
            touched, at_feature = np.unique(features, return_inverse=True)
            grown = np.stack([np.bincount(at_feature, per_word[owner, c], len(touched)) for c in range(k)], axis=1) - ridge * model.weights[touched]
            seen[0][touched] += grown**2
            model.weights[touched] += (rate * grown / np.sqrt(seen[0][touched])).astype(np.float32)
            for values, sums, g in ((model.start, seen[1], slope[heads].sum(axis=0)), (model.move, seen[2], moved)):
                g = g - 0.01 * values
                sums += g**2
                values += (rate * g / np.sqrt(sums)).astype(np.float32)
    return model


def _predict(model: Model):
    index: dict[bytes, int] = {}
    known = [np.zeros((0, len(model.labels)), np.float32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.labels)
        start, move = model.steps() if k else (None, None)
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            rows, ids, total = [], [], 0

            def done():
                lengths = np.array([len(x) for x in ids], np.int64)
                psi = known[0][np.concatenate(ids)].astype(np.float64)
                marginal, _, _ = chains(psi, lengths, start, move)
                sums = np.add.reduceat(marginal, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
                best[rows] = sums.argmax(axis=1)
                score[rows] = np.clip(sums.max(axis=1) / lengths, 0, 1)

            texts, letters = batch.column(1), batch.column(3)
            for row in range(batch.num_rows if k else 0):
                own = words(texts[row].as_py()) if letters[row].as_py() else []
                if not own:
                    continue
                try:
                    found = [index[w] for w in own]
                except KeyError:
                    if len(index) * k > CACHE_CELLS:
                        if ids:
                            done()
                            rows, ids, total = [], [], 0
                        index.clear()
                        known[0] = known[0][:0]
                    new = [w for w in dict.fromkeys(own) if w not in index]
                    known[0] = _grown(known[0], len(index), model.potentials(model.emissions(new)))
                    index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                    found = [index[w] for w in own]
                rows.append(row)
                ids.append(np.array(found, np.int64))
                total += len(found)
                if total * k > CHAIN_CELLS:
                    done()
                    rows, ids, total = [], [], 0
            if ids:
                done()
            names = pa.array([model.labels[b] if b >= 0 else "und" for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), names, pa.array(score)], names=["id", "held_out", "lang_pred", "score"])
        release()

    return run


def _grown(table: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The table, at least doubled if it has no room, with the rows from `used` on set."""
    if used + len(more) > len(table):
        table = np.concatenate((table[:used], np.zeros((max(used + len(more), 1024), table.shape[1]), np.float32)))
    table[used : used + len(more)] = more
    return table


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, train_chars: int) -> Model:
    """The model of a sample of the rows with a language and a text; equal windows of a language count once."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return Model([])
    each = max(LEAST_DOCS, -(-train_docs // len(counts)))
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "of string, share double")
    keyed = rows.join(F.broadcast(shares), F.col("lang") == F.col("of")).withColumn("key", F.xxhash64(F.lit("train"), "id", "text"))
    start = F.pmod(F.xxhash64(F.lit("start"), "key"), F.greatest(F.length("text") - train_chars + 1, F.lit(1))).cast("int") + 1
    picked = keyed.where(F.pmod("key", F.lit(1 << 40)) < F.col("share") * (1 << 40)).select("lang", F.substring("text", start, F.lit(train_chars)).alias("window")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("window"), "window"))
    picked = picked.withColumn("place", place).where(F.col("place") <= 2 * each).select("lang", "window").collect()
    return fit(sorted((r["window"].encode("utf-8", "replace"), r["lang"]) for r in picked))


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, train_docs: int = 3000, train_chars: int = 1500,
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (the mean marginal of lang_pred over the words).

    Learns from rows outside the fold that have a language and a text. A null text, one without a letter and,
    if nothing could be learned, any text is `und` with score 0. Rows that repeat are rows like others. An empty
    table gives an empty result. Other columns are not read.
    """
    model = train(df.where(~held_out(id_col, folds, fold)), id_col, text_col, lang_col, train_docs, train_chars)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), held_out(id_col, folds, fold).alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(model), f"id {kind}, held_out boolean, lang_pred string, score double")
