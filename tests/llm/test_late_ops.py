"""Operators 3, 6, 7, 8, 9, 10 and the pipeline against brute force, SQL, held-out rows and odd rows."""

import itertools
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from symlake.llm import chat, embedding_dedup, langid, line_dedup, sharding, toxicity
from symlake.llm.oracles import ORACLES
from symlake.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, id string, row string, line int, label string, shard string"
ODD = [
    (1, "first line of eight words is right here now\nshared a\nshared b\nend", "en"), (1, "first line of eight words is right here now\nshared a\nshared b\nend", "en"),
    (2, "shared a\nshared b\nother", "en"), (3, None, None), (4, "", "de"), (None, "shared b\nshared a", "de"), (5, "x\nx\nx\nx", None), (6, "word " * 40000, "en"), (7, "12 34 !!", "fr"), (8, "", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", "clash", "clash", 1, "clash", "clash") for i, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


# line dedup


def brute_lines(rows, min_lines, min_words):
    """Deleted lines per row: any run of min_lines lines, or line of min_words words, that an earlier place has."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    gone = defaultdict(set)
    for length in {1, min_lines}:
        seen = set()
        for k in order:
            lines = rows[k][1].split("\n") if rows[k][1] is not None else []
            for at in range(len(lines) - length + 1):
                run = tuple(lines[at : at + length])
                if run in seen and (length == min_lines or len(run[0].split()) >= min_words):
                    gone[k] |= set(range(at, at + length))
                seen.add(run)
    return [sorted(gone[k]) for k in range(len(rows))]


@pytest.mark.parametrize("min_words", [1, 8])
@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_lines_against_brute_force(spark, min_lines, min_words):
    rng = np.random.default_rng(min_lines)
    rows = [(int(i), "\n".join(rng.choice(list("aab cde fgh ij"), rng.integers(0, 14)))) for i in rng.permutation(40)] + [(None, "a\na\na"), (50, "\n\nnew\n"), (51, "\nother\n\nnew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["text"], r["deleted"]) for r in line_dedup.dedup_lines(df, min_lines=min_lines, min_words=min_words).collect()}
    for (i, text), gone in zip(rows, brute_lines(rows, min_lines, min_words), strict=True):
        assert got[i] == ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(gone)), i


def brute_runs(rows):
    """Maximal runs per row: of each place the lines shared with the earliest place that shares the largest power of two of them."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    lines = [rows[k][1].split("\n") if rows[k][1] is not None else [] for k in range(len(rows))]
    places = [(k, at) for k in order for at in range(len(lines[k]))]
    found = defaultdict(dict)
    longest = max((len(x) for x in lines), default=0)
    for h in (1 << k for k in range(longest.bit_length())):
        first = {}
        for k, at in places:
            if at + h > len(lines[k]):
                continue
            run = tuple(lines[k][at : at + h])
            if run in first:
                j, b = first[run]
                n = next((n for n in range(len(lines[k])) if at + n >= len(lines[k]) or b + n >= len(lines[j]) or lines[k][at + n] != lines[j][b + n]), len(lines[k]))
                found[k][at] = (n, rows[j][0], b)
            else:
                first[run] = (k, at)
    return [[(at, *own[at]) for at in sorted(own) if not (at - 1 in own and own[at - 1][0] > own[at][0])] for own in (found[k] for k in range(len(rows)))]


def test_maximal_runs_against_brute_force(spark):
    rng = np.random.default_rng(9)
    long = [f"line {k}" for k in range(1000)]
    rows = [(i, "\n".join(rng.choice(list("abc"), rng.integers(0, 20)))) for i in range(15)]
    rows += [(20, "\n".join(long)), (21, "\n".join(["new", *long, "newer"])), (22, "\n".join(long[300:700])), (None, "a\na\na\na\na"), (23, None), (24, "")]
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "doc_id long, text string")
    got = {r["id"]: [tuple(x) for x in r["runs"] or []] for r in line_dedup.dedup_lines(df).collect()}
    want = dict(zip([i for i, _ in rows], brute_runs(rows), strict=True))
    assert got == want
    assert want[21] == [(1, 1000, 20, 0)] and want[22] == [(0, 400, 20, 300)] and want[None][0][1] >= 1


def test_lines_on_odd_rows(odd, empty):
    rows = [(r["id"], r["lines"], r["deleted"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()]
    assert len(rows) == len(ODD)
    assert sorted(r[2] for r in rows if r[0] == 1) == [0, 4]
    assert (3, 0, 0, None) in rows and (2, 3, 2, "other") in rows and (5, 4, 3, "x") in rows and (4, 1, 0, "") in rows
    assert line_dedup.dedup_lines(empty).count() == 0


# embeddings


def brute_vectors(vectors, labels, threshold=0.98):
    n = len(vectors)
    links, up = [0] * n, list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        a, b = vectors[i], vectors[j]
        if labels[i] is not None and labels[i] == labels[j] and a is not None and b is not None and len(a) == len(b) and float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)) >= threshold:
            links[i] += 1
            links[j] += 1
            up[max(top(i), top(j))] = min(top(i), top(j))
    return [(links[i], top(i)) for i in range(n)]


@pytest.mark.parametrize("limit", [4096, 20])
def test_vectors_against_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 32))
    vectors = [(base[k % 6] + rng.normal(size=32) * (0.08 + 0.03 * (k % 4))).astype(np.float32) for k in range(150)] + [base[0].astype(np.float32)] * 5
    labels = [k % 2 for k in range(len(vectors))]
    df = spark.createDataFrame([(k, [float(x) for x in v], labels[k]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df, bucket_limit=limit).collect()}
    want = brute_vectors([v.astype(np.float64) for v in vectors], labels)
    assert sum(n for n, _ in want) > 500
    assert [got[k] for k in range(len(vectors))] == want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.normal(size=(400, 64)))
    y = embedding_dedup.unit(x + rng.normal(size=x.shape) * 0.1)
    signs, factors, _ = embedding_dedup.codes(x)
    turned = embedding_dedup.rotate(y, 0)
    true, estimate = (x * y).sum(axis=1), (signs * turned).sum(axis=1) / 8 / factors
    assert abs((estimate - true).mean()) < 0.01
    assert (np.abs(estimate - true) <= embedding_dedup.margin(factors, 64)).all()
    assert np.allclose(embedding_dedup.rotate(x, 3) @ embedding_dedup.rotate(y, 3).T, x @ y.T)


def test_vectors_on_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (None, [3.0, 0.0], 1), (12, [1e300, 0.0], 1)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "vec_id long, embedding array<double>, label int, key string, n int")
    got = [(r["id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (12, 4, 1, False), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))], key=str)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


# language ID


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    lengths, k = np.array([3, 0, 1, 4]), 3
    psi, start, move = rng.random((8, k)) + 0.1, rng.random(k) + 0.1, rng.random((k, k)) + 0.1
    got, _, _ = langid.chains(psi, lengths, start, move)
    at = 0
    for n in lengths:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = np.prod([psi[at + t, y] * (start[y] if t == 0 else move[path[t - 1], y]) for t, y in enumerate(path)])
            for t, y in enumerate(path):
                want[t, y] += p
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_languages_held_out(spark, db):
    got = QUERIES["op7_language_id"](spark, DIR).toPandas().merge(db.sql("SELECT doc_id, lang FROM documents").df(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    own = got[got.held_out & got.lang.notna()]
    assert len(own) > 20 and (own.lang == own.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_code_switched_text(spark):
    rng = np.random.default_rng(4)
    words = {"aa": ["kalo", "kalin", "kato", "kasur"], "bb": ["wyth", "wyxen", "wyrd", "wyste"]}
    model = langid.fit([(" ".join(rng.choice(words[lang], 30)).encode(), lang) for lang in words for _ in range(40)])
    text = [b"kalo", b"kato", b"kasur", b"kalin", b"wyth", b"wyrd", b"wyste", b"wyxen"]
    marginal, _, _ = langid.chains(model.potentials(model.emissions(text)).astype(float), np.array([8]), *model.steps())
    assert marginal.argmax(axis=1).tolist() == [0] * 4 + [1] * 4


def test_languages_on_odd_rows(odd, empty):
    rows = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd).collect()}
    assert rows[3] == rows[4] == rows[7] == ("und", 0.0) and rows[6][0] in ("en", "de", "fr")
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


# toxicity


@given(st.lists(st.one_of(st.just(0.0), st.floats(0.5, 5)), max_size=14))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(values):
    drift, scores = 0.7, [v if v else -0.7 for v in values]
    found = toxicity.maximal_segments([(k, v) for k, v in enumerate(values) if v], drift)
    # the definition: take the best segment, then go on left and right of it
    want = []

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 1e-9:
            want.append((best[3], best[4] - 1))
            split(a, best[3])
            split(best[4], b)

    split(0, len(scores))
    assert sum(s for *_, s in found) == pytest.approx(sum(sum(scores[i : j + 1]) for i, j in want))


def test_toxicity_held_out(spark):
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().groupby("doc_id", as_index=False).toxic.max()
    own = got[got.held_out].merge(labels, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (own.predicted == own.toxic).mean() >= 0.95 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (None, 1), (5, None), (4, 7)], "doc_id long, toxic int")
    rows = toxicity.detect(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["id"] in (3, 4, 8)}) == 1
    assert toxicity.detect(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.detect(odd, labels.where("false")).collect()} == {0.5}
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


# chat


def test_perspectives_rebuild_the_dialogue(spark):
    rows = [(c, t, who, f"{who} says {t}" if t % 3 else None) for c in (1, None) for t, who in enumerate(["ann", "bob", "ann", "cy", None, "bob a"])] + [(2, None, "ann", "x"), (2, 1, "ann", "x"), (2, 1, "ann", "x")]
    found = chat.rotate(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")).collect()
    dialogues = defaultdict(list)
    for r in found:
        dialogues[r["conv"], r["perspective"]].append(r)
    assert {p for c, p in dialogues if c == 1} == {"ann", "bob", "cy", "unknown", "bob a"} and {p for c, p in dialogues if c == 2} == {"ann"}
    for (conv, perspective), own in dialogues.items():
        own.sort(key=lambda r: r["seq"])
        text = "".join(r["piece"] for r in own)
        assert [r["seq"] for r in own] == list(range(sum(r[0] == conv for r in rows)))
        for r in own:
            assert text[r["start"] : r["end"]] == r["piece"]
            learned = text[r["learn_start"] : r["learn_end"]]
            assert (learned.endswith(chat.CLOSE) and r["piece"].startswith(chat.OPEN + "assistant\n")) if r["speaker"] == perspective else (learned == "" and "user name=" in r["piece"])


def test_no_dialogues(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# sharding


def test_shards(spark, db):
    got = QUERIES["op10_sharding"](spark, DIR).toPandas().merge(db.sql("SELECT doc_id, text FROM documents").df(), on="doc_id")
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.1 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got["size"] == [len(t.encode()) + 1 for t in got.text]).all() and (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all()
    assert all(g.shard.nunique() == 1 for _, g in got.groupby("text"))


def test_a_hot_group_is_split_and_shards_stay_even(spark):
    rows = [(k, "copy" if k % 2 else f"text number {k} {'x' * (k % 50)}") for k in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.05 * sizes.mean()


def test_shards_on_odd_rows(odd, empty):
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ODD) and {(r["size"], r["crc32"]) for r in rows if r["id"] in (3, 4)} == {(1, 0)}
    assert sharding.shard(empty).count() == 0


def test_quotas_keep_capacity():
    demand, load = [[0, 50, 0], [20, 0, 90], [0, 0, 0]], [100, 120, 30]
    share = sharding.quotas(demand, load, 100.0)
    into = [sum(share[s][t] * demand[s][t] for s in range(3)) for t in range(3)]
    assert into[0] == 20 and into[1] == 20 and into[2] == 70


# pipeline


def test_pipeline_against_its_parts(spark, db):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DIR)
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = docs.toPandas()
        docs = spark.createDataFrame(kept[name], docs.schema)
    toxic = {r["id"] for r in toxicity.detect(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").collect()}
    assert set(kept["toxicity"].doc_id) == set(texts) - toxic
    largest = {}
    for i in kept["toxicity"].doc_id:
        key = (texts[i] or "").translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)}))
        largest[key] = max(i, largest.get(key, i))
    assert sorted(kept["exact dedup"].doc_id) == sorted(largest.values())
    near = kept["SimHash near-dedup"]
    # the stage's rule is a similarity of 0.8 of five-word shingles, whatever the bits of the fingerprints
    before = kept["exact dedup"].sort_values("doc_id")
    words = [fold.split() for fold in before.text.str.lower()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    up = dict.fromkeys(range(len(sets)))

    def top(x):
        while up[x] is not None:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and top(i) != top(j):
            up[max(top(i), top(j))] = min(top(i), top(j))
    assert sorted(near.doc_id) == [i for k, i in enumerate(before.doc_id) if up[k] is None]
    words = kept["mixing sources to target weights"].assign(n=lambda x: x.text.str.split().str.len()).groupby("source").n.sum().sum()
    assert words == pytest.approx(1.5 * near.text.str.split().str.len().sum(), rel=0.1)
    assert kept["packing"].groupby("sequence_id").length.sum().max() <= 2048
    run = corpus_pipeline.run(spark, DIR).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[columns].values.tolist())) == sorted(map(tuple, kept["packing"][columns].values.tolist()))


def test_stages_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (9, 1)], "doc_id long, toxic int")
    labels.write.mode("overwrite").parquet("/tmp/checkpoints/odd/labels.parquet")
    rows = [(20, "same words in the same order for all of us here today", "en"), (None, "SAME words in the same order for all of us here today", "en"), (None, None, None)]
    docs = odd.unionByName(spark.createDataFrame([(i, t, lang, None, "clash", "clash", 1, "clash", "clash") for i, t, lang in rows], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, empty):
            after = stage(spark, given, "/tmp/checkpoints/odd")
            if given is empty:
                assert after.count() == 0, name
        if name == "packing":
            break
        assert after.columns == docs.columns
        docs = spark.createDataFrame(stage(spark, docs, "/tmp/checkpoints/odd").collect(), SCHEMA)
        ids = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert len({t for _, t in ids if t}) >= 5
        if name == "exact dedup":
            # largest id of equal texts, one of repeated rows; null and empty texts are equal
            assert [i for i, t in ids if not t] == [8] and [i for i, t in ids if t and t.lower().startswith("same")] == [20] and len([i for i, _ in ids if i == 1]) == 1
    pieces = corpus_pipeline.pack_documents(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and all(r.offset == 0 for r in pieces)


def test_no_table_is_left_but_those_in_use(spark):
    import os

    before = set(os.listdir("/tmp/checkpoints"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = [line_dedup.dedup_lines(docs), sharding.shard(docs), embedding_dedup.near_vectors(spark.read.parquet(f"{DIR}/embeddings.parquet"))]
    left = {name: sorted(os.listdir(f"/tmp/checkpoints/{name}")) for name in set(os.listdir("/tmp/checkpoints")) - before}
    assert sorted(x for own in left.values() for x in own) == ["docs", "gone", "of", "placed", "rows"] and all(df.count() for df in held)
