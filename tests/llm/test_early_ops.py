"""Operators 1, 2, 4 and 5 against brute force and on odd rows."""

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from symlake.llm import exact_dedup, mixing, packing, simhash
from symlake.llm._common import LOWER, UPPER, Scratch
from symlake.llm.components import components
from symlake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, digest string, label string"
DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [
    (1, "Some Words here and there", "b"), (1, "Some Words here and there", "b"), (2, "some words HERE and there", "b"), (3, None, None), (4, "", "a"),
    (None, "some words here and there", "c"), (5, " \t\n\x0b\x0c\r ", "a"), (6, "Ünï code ÄÖ <|endoftext|>", "Ä"), (7, "x" * 5000, "a"), (8, "a b " * 30000, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", s, 1, "clash", "clash", "clash", "clash") for i, t, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def test_copies_on_odd_rows(odd, empty):
    rows = exact_dedup.copies(odd, counters=2).collect()
    assert len(rows) == len(ODD)
    group = [r for r in rows if r["group_size"] == 4]
    assert len(group) == 4 and {r["keep_id"] for r in group} == {2} and [r["id"] for r in group if r["kept"]] == [2]
    blank = [r for r in rows if bytes(r["digest"]) == hashlib.sha256(b"").digest()]
    assert {(r["id"], r["keep_id"], r["kept"]) for r in blank} == {(3, 4, False), (4, 4, True)}
    assert exact_dedup.copies(empty).count() == 0


def test_copies_without_any_id_keep_one(spark):
    rows = exact_dedup.copies(spark.createDataFrame([(None, "a")] * 3, "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in rows) == 1


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(odd, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7, 8]
    assert exact_dedup.drop_copies(odd.where("doc_id = 1")).count() == 1
    assert exact_dedup.drop_copies(empty).count() == 0


@given(st.lists(st.integers(0, 9), max_size=200), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_misra_gries_bound(items, counters):
    found = exact_dedup.Counter()
    for at in range(0, len(items), 7):
        found = exact_dedup.misra_gries(found, exact_dedup.Counter(items[at : at + 7]), counters)
    true = exact_dedup.Counter(items)
    assert len(found) <= counters
    assert all(0 <= true[k] - found[k] <= len(items) / (counters + 1) for k in true)


def test_water_level_against_loop(spark):
    rows = [(0, 3, 10.0), (1, 1, 500.0), (2, 2, 40.0), (3, 3, 900.0), (4, 1, 0.0)]
    level = mixing.water_level(spark.createDataFrame([(w, c) for _, w, c in rows], "weight int, cap double"), 700.0)
    share, free = {}, {i for i, _, _ in rows}
    while True:
        left, weight = 700.0 - sum(share.values()), sum(w for i, w, _ in rows if i in free)
        over = {i: c for i, w, c in rows if i in free and left * w / weight > c}
        if not over:
            break
        share |= over
        free -= set(over)
    share |= {i: left * w / weight for i, w, _ in rows if i in free}
    assert np.allclose([min(c, w * level) for _, w, c in rows], [share[i] for i, _, _ in rows])


def test_mix_on_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {s for _, _, s in ODD}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= len(own) + 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(odd).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    assert mixing.repeat(odd).columns == odd.columns and mixing.repeat(empty).count() == 0


def test_mix_meets_targets(spark):
    rows = mixing.mix(spark.read.parquet(DOCS)).toPandas()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 2).all() and (per.target <= 2 * per["size"]).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()


def test_tokens_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = [r.text for r in spark.read.parquet(DOCS).collect()] + [t for _, t, _ in ODD] + ["é İ'S don't x\u0085y ΣΑΣ 한국 12345 <|startoftext|>a b<|endoftext|>c", "word,word. WORD? it's. a.b x" + "y" * 99, "́ a"]
    texts += ["Don't, DON'T!! l'été,%%% ÉTÉ... ß ǅ İstanbul I\u0307 K Å e\u0301t e\u0301, ÀÉ'S &&& 'tis x' y's' 9a a9, a_b -- ŉ ª º", "<|STARTOFTEXT|> A<|endoftext|>B <|", "\u00a0a\u00a0 \u2003b a\u200bb \x1c\x1f c", "ТЕСТ слово, 中文文本。 ไทย ｆｕｌｌ，"]
    own = packing.encoder(tokenizer_path())
    for text in texts:
        want = plain.encode(text or "", add_special_tokens=False).ids
        for _ in range(2):
            assert np.frombuffer(own.texts([(text or "").encode()])[0], "<u2").tolist() == want
    many = own.texts([(t or "").encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in many] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_tokens_of_random_texts_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    plain, own, rng = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), np.random.default_rng(8)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 50)
    signs = [*"aAbEéÉßIİsStT'.,;!&%<|>-_#0 9\n\t\u0301\u0307\u00a0\u2028ΣσжЖ中"]
    for _ in range(300):
        texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(3)]
        assert [np.frombuffer(x, "<u2").tolist() for x in own.texts([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_signs_after_words_are_not_learned_with_each_word():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    texts = ["Word, wörd. word! WORD?! word", "wörd, word? ?! it's, " + "x" * 99 + "." * 70 + " word<| word"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.texts([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(own.cache) == {b"word", "wörd".encode(), b",", b".", b"!", b"?!", b"?", b"it's,"}
    assert own.texts([]) == [] and own.texts([b"", b" \n"]) == [b"", b""]
    several = own.texts([b"a \xff b", " ".join(["word,"] * 3).encode()])
    assert np.frombuffer(several[1], "<u2").tolist() == plain.encode("word, " * 3, add_special_tokens=False).ids


def test_words_of_each_letter_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    texts = [f"{c} a{c}b A{c}{c}s., x'{c} {c}'s" for c in map(chr, range(0x80, 0x300))]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.texts([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_strips_and_batches_of_one_text(monkeypatch):
    from tokenizers import Tokenizer

    text = " ".join(f"word{k % 7}, and b{'é' * (k % 3)}." for k in range(500))
    want = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 1]
    monkeypatch.setattr(packing, "STRIP", 13)
    monkeypatch.setattr(packing, "IDS_BYTES", 3 * 4 * 64)
    batch = pa.record_batch([pa.array([5, 6, 7]), pa.array([None, text.encode(), b""], pa.binary())], names=["id", "text"])
    found = list(packing._pieces(tokenizer_path(), 1, 64)(iter([batch])))
    rows = [r for b in found for r in b.to_pylist()]
    assert max(b.num_rows for b in found) == 3 and [r["id"] for r in rows] == [5, *[6] * (len(rows) - 2), 7]
    assert np.frombuffer(b"".join(r["ids"] for r in rows[1:-1]), "<u4").tolist() == want
    assert [r["start"] for r in rows[1:-1]] == np.concatenate(([0], np.cumsum([r["length"] for r in rows[1:-2]]))).tolist()
    assert {r["doc_tokens"] for r in rows[1:-1]} == {len(want)} and [r["doc_tokens"] for r in (rows[0], rows[-1])] == [1, 1]


def test_pack_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    pieces = packing.pack(docs, tokenizer_path()).toPandas()
    assert pieces.sequence_id.is_unique and (pieces.offset == 0).all()
    assert (2**pieces.bucket == pieces.length).all() and pieces.length.max() <= 2048
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, own in pieces.sort_values("start").groupby("id"):
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 1] and own.doc_tokens.iloc[0] == len(ids)
        assert own.start.tolist() == np.concatenate(([0], own.length.cumsum()[:-1])).tolist()
    rows = packing.pack(odd, tokenizer_path()).collect()
    assert sum(r["length"] for r in rows if r["id"] == 3) == 1 and len({r["sequence_id"] for r in rows}) == len(rows)
    assert packing.pack(empty, tokenizer_path()).count() == 0


@given(st.integers(1, 10**6), st.sampled_from([1, 2, 64, 2048]))
def test_lengths(tokens, longest):
    found = packing.lengths(tokens, longest)
    assert sum(found) == tokens and all(n <= longest and n & (n - 1) == 0 for n in found)
    assert len({n for n in found if n < longest}) == len([n for n in found if n < longest])


def brute_fingerprint(text):
    words = [w for w in fold(text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, ids):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            up[top(i)] = top(j)
    least = {}
    for i in range(len(fps)):
        least[top(i)] = min(ids[i], least.get(top(i), ids[i]))
    return [least[top(i)] for i in range(len(fps))]


def test_triples_cover_every_four_positions():
    found = {frozenset(t) for t in simhash.position_triples()}
    assert len(found) == 20
    assert all(any(t <= set(four) for t in found) for four in itertools.combinations(range(8), 4))


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = dict(zip(ids, zip(fps, brute_components(fps, ids), strict=True), strict=True))
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_against_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    fps = {0, 2**64 - 1, 0xFFFFFFFF00000000, 1, 2**63 + 3, 2**63 + 12}  # far but for a sign, and pairs across bit 63
    for base in rng.integers(0, 2**63, 6).tolist():
        for _ in range(12):
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.add(base)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    scratch = Scratch(spark, "test")
    found = components(scratch, simhash.links(scratch, spark.createDataFrame([(f,) for f in signed], "fp long"), limit))
    label = {r["node"]: r["label"] for r in found.collect()}
    want = brute_components(fps, signed)
    assert [label.get(f, f) for f in signed] == want


def test_near_copies_on_odd_rows(odd, empty):
    rows = {(r["id"], r["component_id"]): r["fp"] for r in simhash.near_copies(odd).collect()}
    assert rows[3, 3] == rows[4, 3] == rows[5, 3] == 0 and (None, 1) in rows and (2, 1) in rows
    assert simhash.near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 6, 7, 8]
    assert zlib.crc32(b"") == 0
