"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are the binary digits of its token count, the largest
piece being the sequence length; every piece is a sequence of its own. Sequences of one length form a
bucket, none crosses documents and none is padded. No rows are shuffled.

Tokens are found chunk by chunk: the tokenizer's own rules never let a token or a merge cross ASCII
white space. Texts are split and their different chunks numbered in native code; signs after a word are
taken off, and the ids of words and other chunks are kept and reused while a task runs. The rules lower-case
all text, so chunks are looked up in lower case, and words of plain letters skip the rules and go to the merges at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release

#: Words and chunks whose ids a worker keeps before it lets go those that the text at hand does not use, and the longest kept, in bytes.
CACHE_CHUNKS, CACHE_BYTES = 450_000, 64
#: Bytes of text and chunks looked up at once, new ones encoded at once, and bytes of ids in a batch of pieces,
#: so that many or very long texts need no more memory than others.
TEXT_BYTES, STRIP, STEP, IDS_BYTES = 4 << 20, 1 << 19, 1 << 14, 32 << 20
#: The tokenizer's special token that separates chunks in a text to encode, and how its special tokens begin.
SEPARATOR, SPECIAL = "<|startoftext|>", b"<|"
#: ASCII signs: a run of them at the end of a word is split from it by the tokenizer's rules.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words of letters up to U+024F but U+0130 in UTF-8: each is composed already, so that the rules leave it as it is but for its case.
PLAIN = r"^(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|\xC4[\x80-\xAF\xB1-\xBF]|[\xC5-\xC8][\x80-\xBF]|\xC9[\x80-\x8F])+$"

_PLAIN = re.compile(PLAIN.encode())
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit numbers, by a tokenizer file with fewer than 65536 ids."""

    def __init__(self, path: str):
        # one thread per worker: more would each hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("the tokenizer has ids beyond 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _raw(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")

    def chunks(self, own: list[bytes]) -> list[bytes]:
        """The ids of each chunk by all of the tokenizer's rules; chunks are encoded as one text."""
        if not own:
            return []
        texts = [c.decode("utf-8", "replace") for c in own]
        ids = self._raw(self.whole, SEPARATOR.join([*texts, ""]))
        cuts = np.flatnonzero(ids == self.whole.token_to_id(SEPARATOR))
        if len(cuts) != len(own):  # a chunk holds the separator
            return [self._raw(self.whole, text).tobytes() for text in texts]
        return _parts(ids, cuts, 0)

    def plain(self, own: str) -> list[bytes]:
        """The ids of each word of lower-case letters, the words being separated by blanks; the last token of a word ends it."""
        ids = self._raw(self.words, own)
        return _parts(ids, np.flatnonzero(self.ends[ids]) + 1, 1)

    def learn(self, new: list[bytes]) -> None:
        """Puts the ids of new words and other chunks into the cache."""
        words, others = [], []
        for c in new:
            (words if _PLAIN.match(c) else others).append(c)
        for at in range(0, len(words), STEP):
            some = words[at : at + STEP]
            self.cache.update(zip(some, self.plain(b" ".join(some).decode().lower()), strict=True))
        for at in range(0, len(others), STEP):
            self.cache.update(zip(others[at : at + STEP], self.chunks(others[at : at + STEP]), strict=True))

    def values(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each word, chunk or run of signs; those of long ones and of special tokens are not kept."""
        cache = self.cache
        found = list(map(cache.get, keys))
        places = [k for k, ids in enumerate(found) if ids is None]
        if len(cache) + len(places) > CACHE_CHUNKS:
            kept = {c: ids for c, ids in zip(keys, found, strict=True) if ids is not None}
            cache.clear()
            cache.update(kept)
        self.learn([c for c in map(keys.__getitem__, places) if len(c) <= CACHE_BYTES and SPECIAL not in c])
        for k in places:
            c = keys[k]
            found[k] = cache[c] if c in cache else self.chunks([c])[0]
        return found

    def strip(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many bytes of them each chunk has."""
        coded = chunks.dictionary_encode()
        own = coded.dictionary
        base = pc.ascii_rtrim(own, characters=SIGNS.decode())
        plain = pc.match_substring_regex(base.view(pa.binary()), PLAIN)
        special = pc.match_substring(own, SPECIAL.decode())
        if special.true_count:
            plain = pc.and_not(plain, special)
        keys = pc.if_else(plain, base, own).dictionary_encode()
        # signs after a word are found by themselves; place 0 is for none
        signs, after = {b"": 0}, np.zeros(len(own), np.int32)
        ended = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (_sizes(base) < _sizes(own)))
        if len(ended):
            words = zip(_list(own.take(pa.array(ended))), _sizes(base)[ended].tolist(), strict=True)
            after[ended] = [signs.setdefault(c[n:], len(signs)) for c, n in words]
        words = _list(keys.dictionary)
        found = self.values([*words, *list(signs)[1:]])
        ids = pa.array(found[: len(words)], pa.large_binary()).take(keys.indices)
        if len(ended):
            more = pa.array([b"", *found[len(words) :]], pa.large_binary()).take(pa.array(after))
            ids = pc.binary_join_element_wise(ids, more, pa.scalar(b"", pa.large_binary()))
        ids = ids.take(coded.indices)
        offsets = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1]
        data = ids.buffers()[2]
        return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)), np.diff(offsets)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of binary texts without nulls one after another, and how many each text has."""
        texts = texts.view(pa.string())  # nothing below asks for valid UTF-8
        lowered, special = pc.ascii_lower(texts), pc.match_substring(texts, SPECIAL.decode())
        if special.true_count:  # a text with special tokens is not folded
            lowered = pc.if_else(special, texts, lowered)
        own = pc.ascii_split_whitespace(lowered)
        chunks, ends = own.flatten(), np.zeros(len(own) + 1, np.int64)
        np.cumsum(pc.list_value_length(own).to_numpy(), out=ends[1:])
        strips = [self.strip(chunks.slice(at, STRIP)) for at in range(0, len(chunks), STRIP)]
        if not strips:
            return np.zeros(0, "<u2"), np.zeros(len(own), np.int64)
        places = np.concatenate([[0], *[sizes for _, sizes in strips]]).cumsum()[ends]
        return np.concatenate([data for data, _ in strips]).view("<u2"), np.diff(places) // 2

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        ids, counts = self.ids(pa.array(texts, pa.binary()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def _parts(ids: np.ndarray, cuts: np.ndarray, gap: int) -> list[bytes]:
    """The ids up to each cut; the id at a cut belongs to nothing if gap is 0."""
    joined, at, out = ids.tobytes(), 0, []
    for cut in (cuts * 2).tolist():
        out.append(joined[at:cut])
        at = cut if gap else cut + 2
    return out


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False)


def _list(texts: pa.Array) -> list[bytes]:
    return texts.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; its cache is emptied when a task ends."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def lengths(tokens: int, longest: int) -> list[int]:
    """The pieces of a document: full sequences first, then the binary digits of the rest, largest first."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _slabs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs start and stop of texts that hold TEXT_BYTES together at most, a longer text by itself."""
    start = size = 0
    for place, own in enumerate(_sizes(texts).tolist()):
        if place > start and size + own > TEXT_BYTES:
            yield start, place
            start, size = place, 0
        size += own
    if len(texts) > start:
        yield start, len(texts)


def _pieces(path: str, end_id: int, longest: int):
    most = max(1, IDS_BYTES // (4 * longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).fill_null(b"")
            for start, stop in _slabs(texts):
                some = texts.slice(start, stop - start).cast(pa.binary())
                yield from pieces(batch.column(0).slice(start, stop - start), *own.ids(some))
        # workers outlive tasks, and other stages need the memory
        own.cache.clear()
        release()

    def pieces(keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
        cut = [lengths(n, longest) for n in (counts + 1).tolist()]
        owner = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        length = np.array([n for x in cut for n in x], np.int64)
        ends = np.cumsum(length)
        before = np.concatenate(([0], np.cumsum(counts + 1)))
        for at in range(0, len(length), most):
            some = slice(at, at + most)
            first, doc = ends[at] - length[at], owner[some]
            offsets = np.concatenate(([0], ends[some] - first)).astype("<i4") * 4
            data = pa.py_buffer(ids[first : first + offsets[-1] // 4].tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), data])
            columns = [keys.take(pa.array(doc)), pa.array(ends[some] - length[some] - before[doc]), pa.array(length[some]), binary, pa.array(counts[doc] + 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens"])

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, longest: int = 2048) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    tokenizer is the path of a tokenizer file, present on every executor. A document's ids end with
    end_id, so a null or empty text is one piece of length 1. bucket is the base-2 logarithm of the
    length; a sequence holds one piece, at offset 0. Rows that repeat an id are packed once each, with
    sequences of their own. An empty table gives an empty result. Other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_pieces(tokenizer, end_id, longest), f"id {kind}, start long, length long, ids binary, doc_tokens long")
    return found.withColumns({"bucket": F.round(F.log2("length")).cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
