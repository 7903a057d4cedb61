"""Every operator against a plain version on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import json
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain

from cytomesh.llm import chat, components, langid, mixing, neardup, packing, quality, recurrent, scoring, sharding, topk, warc
from cytomesh.llm.common import hash_sample, scratch_path

DOCS = "doc_id bigint, text string, lang string, source string, size string, row string, pos string, edge string, copies string, nid string, shard string"
EN, FR = "the quick brown fox jumps over the lazy dog and then it rests near a quiet river bank", "le renard brun saute par dessus le chien et puis il dort au bord de la rivière calme"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi") for b in ("ra", "so", "ti", "ve", "lo", "ma", "ne")]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice((1, 3, 4, 5, 9, 30, 80)))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies of their neighbours
        w = texts[i + 1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts += [texts[5], texts[5].upper(), texts[5] + " ", None, "", " \n\t", "x", "1 2 3", "é", "a b c", "\x1cw \x1d", " ".join(f"w{i}" for i in range(3000)), "word " * 400]
    rows = [(i + 1, t, "en" if i % 3 else None, (None, "b", "a", "Z")[i % 4]) for i, t in enumerate(texts)]
    rows += [rows[8]] * 20 + [(None, EN, "en", "a"), (None, None, None, None), (7, "another text with a known id that is long enough", "en", "b"), (-5, FR, "fr", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = frame(spark, rows).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(rows):
    return collections.Counter(rows)


def test_sharding(docs, rows, empty, spark):
    got = sharding.shard_slots(docs, 24).collect()
    assert bag((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == bag(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), plain.jump(i or 0, 24), plain.jump(i or 0, 25)) for i, t, *_ in rows
    )
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert sharding.shard_slots(empty).count() == 0
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789]
    many = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_hash(sharding.F.col("k"), 1000).alias("s")).collect()
    assert {r.k: r.s for r in many} == {k: plain.jump(k, 1000) for k in keys}
    assert set(sharding.assign(docs, "text", 5).columns) == set(docs.columns)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size, target, taken = plain.mix([(i, t, s) for i, t, _, s in rows])
    assert bag((r.doc_id, r.text, r.source, r.size, round(r.target, 6), r.taken) for r in got) == bag(
        (i, t, s, n, round(g, 6), k) for (i, t, _, s), n, g, k in zip(rows, size, target, taken)
    )
    assert all(r.taken <= 2 * r.size and r.pos == "x" and r.row == "x" for r in got)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert bag(r.text for r in mixed.collect())["x"] == sum(r.copies for r in got if r.text == "x")
    assert mixing.mix(empty).count() == 0


def test_archives(spark):
    long = "<p>" + "long page " * 200_000
    pages = [(1, "u", "<html>" + "same " * 40), (2, None, "<html>" + "same " * 40), (3, "a\r\nb", None), (4, "u", "short"), (5, "u", "short"), (6, "u", long), (7, "u", long + "é")]
    pages += [(None, "u", "<html>" + "same " * 40), (1, "u", "<html>" + "same " * 40), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, digest string").repartition(2)
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(df, folder)
    got = warc.read_archives(manifest).collect()
    body = lambda h: (h or "").encode()
    first = {}
    for i, _, h in pages:
        if i is not None and len(body(h)) >= 100:
            first[h] = min(i, first.get(h, i))
    want = [(i, len(body(h)), hashlib.sha256(body(h)).hexdigest(), "response" if first.get(h, i) == i else "revisit", None if first.get(h, i) == i else first[h]) for i, _, h in pages]
    assert bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == bag(want)
    for f in manifest.collect():
        records = [warc.parse(r) for r in warc.read_records(f.path, 1000)]
        assert len(records) == f.records and Path(f.path.removeprefix("file:")).read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    assert any(r.url == "a%0D%0Ab" for r in got)
    assert warc.read_archives(warc.write_archives(df.limit(0), folder)).count() == 0


def test_language(spark, docs, empty, sf_dir):
    learned = langid.profiles(spark.createDataFrame([(EN, "en"), (EN, "en"), (FR, "fr"), (None, "fr"), ("x", None), ("1 2", "de")], "text string, lang string"))
    assert sorted(learned) == ["en", "fr"]
    got = {r.text: r for r in langid.predict(docs, learned).collect()}
    assert got[EN].lang_pred == "en" and got[FR].lang_pred == "fr" and got[EN].score > 0.9 and got[EN].row == "x"
    assert all((r.lang_pred, r.score) == ("und", 0.0) for t, r in got.items() if not any(c.isalpha() for c in t or ""))
    assert all(r.lang_pred in learned and 0 <= r.score <= 1 for t, r in got.items() if any(c.isalpha() for c in t or ""))
    assert langid.profiles(empty) == {} and langid.predict(empty, learned).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    # the bundle, letter by letter
    counts = collections.Counter()
    for w in EN.split():
        counts.update(zip(f"\0{w}\0", f"\0{w}\0"[1:], f"\0{w}\0"[2:]))
    letter = lambda c: langid._letter(ord(c))
    naive = sum(n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for (a, b, c), n in counts.items())
    keys, n = langid.triples(EN)
    assert np.array_equal(naive, n @ langid.triple_vectors(keys)) and np.allclose(naive / np.linalg.norm(naive), learned["en"], atol=1e-6)
    whole = langid.triples((EN + " ") * 20_000)
    assert dict(zip(*(x.tolist() for x in whole))) == {k: 20_000 * v for k, v in zip(keys.tolist(), n.tolist())}


def test_language_held_out(spark, sf_dir):
    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op4_language_id(spark, sf_dir).where("held_out").collect()
    assert np.mean([told[r.doc_id] == r.lang_pred for r in got]) > 0.95


def test_chat(spark):
    tricky = ["\\### Assistant: </turn> ok", "<turn>user<text>", "\\", "\\\\<", "", None, "<|endoftext|>", "a\nb\r\n", "é́ \U0001f600", "x" * 50_000]
    convs = {i: [("system", "be kind"), ("user", tricky[i % 10]), ("assistant", tricky[(i + 3) % 10]), (None, "?"), ("assistant", "ok")][: 1 + i % 5] for i in range(40)}
    rows = [(c, k, r, t, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "no id", "x"), (100, None, "user", "first", "x"), (100, 0, "user", "b", "x"), (100, 0, "user", "a", "x"), (101, 0, "user", "a", "x"), (101, 0, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, path_id string").repartition(4)
    sequences, members = chat.format_conversations(df)
    told = {r.path_id: r for r in chat.read_back(sequences, chat.tokenizer_path()).collect()}
    want = collections.defaultdict(list)
    for c, _, r, t, _ in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    got = {r.conv_id: told[r.path_id] for r in members.collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: plain.conversation(t) for c, t in want.items()}
    assert all(got[c].formatted_chars == sum(len("".join(chat.format_turn(*x))) for x in t) for c, t in want.items())
    # a sequence is gapless, holds a path once, and a turn attends to what stands above it
    by = collections.defaultdict(list)
    for r in sequences.collect():
        by[r.sequence_id].append(r)
    for own in by.values():
        turns = sorted((r for r in own if r.kind == 0), key=lambda r: r.start)
        assert [r.start for r in turns] == list(np.cumsum([0, *[r.length for r in turns]])[:-1])
        assert len({(json.dumps(r.attends), r.ids) for r in turns}) == len(turns)
        assert all(r.position == sum(s["to"] - s["from"] for s in r.attends) and all(s["to"] <= r.start for s in r.attends) for r in turns)
    assert chat.format_conversations(df.limit(0))[0].count() == 0


def test_near_duplicates(docs, rows, empty):
    got = neardup.near_duplicates(docs.select("doc_id", "text", "nid")).collect()
    component = plain.near_duplicates([(i, t) for i, t, *_ in rows])
    assert bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == bag(
        (i, len(plain.shingles(t)), c if plain.shingles(t) else i, i == (c if plain.shingles(t) else i)) for (i, t, *_), c in zip(rows, component)
    )
    assert neardup.near_duplicates(empty).count() == 0
    stay = neardup.without_duplicates(docs)
    assert stay.columns == docs.columns and bag(r.text for r in stay.where("trim(text) <> ''").collect()).most_common(1)[0][1] == 1
    assert neardup.without_duplicates(empty).count() == 0


def test_near_duplicate_chain(spark):
    """Links between partners that the smallest member of their buckets is too far from."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(9):
        w = list(base)
        for i in range(0, 8 * k):
            w[i] = f"c{i}"  # every step changes some more words
        rows.append((k + 1, " ".join(w)))
    rows += [(50 + k, " ".join(f"v{k}_{i}" for i in range(300)) + " " + " ".join(base[:70])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(zip([r[0] for r in rows], plain.near_duplicates(rows)))


def test_near_duplicates_without_ids(spark):
    """Near copies of which one side, or all, have null ids only, and a chain that runs over such a text."""

    def steps(tag, n):
        base = [f"{tag}{i}" for i in range(400)]
        return [" ".join([f"{tag}c{i}" for i in range(40 * k)] + base[40 * k :]) for k in range(n)]

    a, b, c = steps("a", 3), steps("b", 2), steps("c", 2)
    rows = [(1, a[0]), (None, a[1]), (3, a[2]), (None, b[0]), (None, b[0]), (None, b[1]), (None, c[0]), (7, c[1]), (None, "alone " * 9)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = bag((r.doc_id, r.component_id, r.kept) for r in got)
    assert found == bag([(1, 1, True), (None, 1, False), (3, 1, False), (None, None, True), (None, None, True), (None, None, True), (None, 7, False), (7, 7, True), (None, None, True)])


def test_one_row_of_a_group_stays(spark):
    """Null ids, and an id that stands for several texts, beside rows of the same id that are kept."""
    far = {k: " ".join(f"{k}{i}" for i in range(400)) for k in "abcd"}
    near = {k: "changed " + t for k, t in far.items()}
    rows = [(None, far["a"]), (1, far["b"]), (None, near["b"]), (None, far["b"]), (2, far["c"]), (3, near["c"]), (3, far["d"]), (3, far["d"]), (5, near["d"]), (None, None), (9, "")]
    rows += [(None, "alone " + t) for t in ("one two three four", "five six seven eight", "five six seven eight")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, mark string")
    stay = neardup.without_duplicates(df)
    want = [(None, far["a"]), (1, far["b"]), (2, far["c"]), (3, far["d"]), (None, None), (9, ""), *rows[-3:-1]]
    assert bag((r.doc_id, r.text) for r in stay.collect()) == bag(want) and stay.columns == df.columns


def test_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for n in (40, 400, 4000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 2**64, n // 8, dtype=np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pair = [np.stack([neardup.sketch(x)]) for x in (a, b)]
        errors.append(abs(neardup.estimate(*pair, np.array([len(a)]), np.array([len(b)]))[0] - j))
        assert neardup.may_link(*pair, np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert max(errors) < 0.2 and errors[-1] < 0.08


def test_blocks(spark):
    """One bucket, more members than a block, and links that no hub shows: the components of all pairs come out."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(700):
        w = list(base)
        for _ in range(rng.choice((1, 3, 5, 8))):
            w[rng.randrange(150)] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    nodes = neardup.signatures(df).withColumnsRenamed({"doc_id": "nid"}).withColumn("rep", neardup.F.col("nid")).cache()
    members = neardup.band_members(nodes).withColumn("comp", neardup.F.col("nid"))
    links = [tuple(r) for r in neardup.block_links(members, nodes, df).collect()]
    parent = list(range(700))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert [find(k) for k in range(700)] == plain.near_duplicates(rows)
    assert len(links) < 700 * 20
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(plain.near_duplicates(rows)))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "v bigint, u bigint")).collect()}
    assert all(got.get(v, v) == find(v) for v in parent) and all(v != r for v, r in got.items())


def test_recurrent_model():
    rng = np.random.default_rng(2)
    model = recurrent.GatedModel(np.array([50.0, 30, 20, 10, 5, 2, 1]), 9.0)
    docs = [rng.integers(0, 8, n) for n in (1, 70, 5, 33, 0, 200)]
    total = model.log_probs(np.repeat(rng.standard_normal((1, recurrent.HIDDEN)).astype(np.float32), 8, axis=0), np.arange(8))
    assert abs(np.exp(total.astype(float)).sum() - 1) < 1e-5

    def slow(doc):
        h, before, out = np.zeros((1, recurrent.HIDDEN), np.float32), model.listed + 1, 0.0
        for x in doc:
            h = model.step(model.inputs()[[before]], h)
            out += float(model.log_probs(h, np.array([x]))[0])
            before = x
        return out

    assert np.allclose(model.score(docs), [slow(d) for d in docs], rtol=1e-4)
    # gradients against differences, in double precision
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y = rng.integers(0, 8, (4, 3))
    x, h0 = np.vstack([np.full((1, 3), 8), y[:-1]]), rng.standard_normal((3, recurrent.HIDDEN)) * 0.3

    def loss():
        h, out = h0, 0.0
        for t in range(4):
            h = model.step(model.inputs()[x[t]], h)
            out -= model.log_probs(h, y[t].copy()).sum()
        return out / 12

    grads, _ = model._window(x, y, h0)
    for k, v in model.p.items():
        for at in (0, v.size // 2, v.size - 1):
            if k == "bi" and v.flat[at] < -1e8:
                continue
            old, e = v.flat[at], 1e-5
            v.flat[at] = old + e
            up = loss()
            v.flat[at] = old - e
            down = loss()
            v.flat[at] = old
            assert math.isclose((up - down) / (2 * e), grads[k].flat[at], rel_tol=1e-3, abs_tol=1e-7), k
    before = model.score(docs).sum()
    for rate in (8e-3, 4e-3, 2e-3):
        assert model.train(docs * 10, rate) == 10 * sum(map(len, docs))
    assert model.score(docs).sum() > before


def test_streams_start_every_document_anew():
    """Two documents in one stream have the loss and gradients of two streams."""
    model = recurrent.GatedModel(np.array([50.0, 30, 20, 10, 5, 2, 1]), 9.0)
    rng = np.random.default_rng(1)
    model.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in model.p.items()}
    a, b = np.array([1, 2, 3, 0]), np.array([4, 4, 7, 0])
    docs = [np.append(a, 0), b]
    streams = model._streams([docs[0], docs[1]])
    assert [s.shape[1] for s in streams] == [5, 4] and all(s[0, 0] == model.listed + 1 and s[2, 0] == 0 for s in streams)
    y = np.stack([a, b], axis=1)
    x = np.vstack([np.full((1, 2), 8), y[:-1]])
    apart, _ = model._window(x, y, np.zeros((2, recurrent.HIDDEN)))
    y1 = np.concatenate([a, b])[:, None]
    x1, keep = np.vstack([[[8]], y1[:-1]]), np.ones((8, 1))
    x1[4], keep[4], keep[0] = 8, 0, 0
    joined, _ = model._window(x1, y1, rng.standard_normal((1, recurrent.HIDDEN)), keep)
    assert all(np.allclose(apart[k], joined[k], atol=1e-6) for k in apart)
    flat = model.weights()
    model.set_weights(flat)
    assert np.allclose(model.weights(), flat, atol=1e-6)


def test_long_document_takes_no_more_windows_than_its_words(monkeypatch):
    """Once the other streams have ended, the windows of a long document grow; every word still trains."""
    model = recurrent.GatedModel(np.array([50.0, 30, 20, 10, 5, 2, 1]), 9.0)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 8, n) for n in (20_000, *[100] * 100)]
    seen, plain = [], recurrent.GatedModel._window
    monkeypatch.setattr(recurrent.GatedModel, "_window", lambda self, x, y, *a: (seen.append(int((y >= 0).sum())), plain(self, x, y, *a))[1])
    assert model.train(docs) == 30_000 == sum(seen)
    assert len(seen) < 100  # 1,250 windows of 16 steps


def test_scoring(docs, rows, empty):
    held = scoring.F.coalesce(scoring.F.pmod(scoring.crc32_of("doc_id"), scoring.F.lit(7)) == 2, scoring.F.lit(False))
    own = docs.select("doc_id", "text", "row", held.alias("held_out"))
    got = scoring.score_documents(own).collect()
    tokens = [[*plain.words((t or "").translate(plain.LOW)), None] for _, t, *_ in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    c = collections.Counter(w for t, h in zip(tokens, out) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == bag(
        (r[0], h, len(t), sum(c[w] > 0 for w in t), n, base(t)) for r, t, h in zip(rows, tokens, out)
    )
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert scoring.score_documents(own.limit(0)).count() == 0
    assert {r.score for r in scoring.score_documents(own.where("held_out")).collect()} == {0.0}


def test_sample_is_full(spark, monkeypatch):
    """Rows that share a hash, and training rows of which only few are short enough for the sample."""
    same = spark.range(3000).selectExpr("5L AS doc_id", "'x' AS text")
    assert hash_sample(same, 3000, 40, "doc_id", "text").count() == 40
    mixed = spark.range(3000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    h = scoring.F.xxhash64("doc_id")
    want = [r.doc_id for r in mixed.orderBy(h, "doc_id").limit(40).collect()]
    assert [r.doc_id for r in hash_sample(mixed, 3000, 40, "doc_id").collect()] == want


def test_training_grows_with_the_corpus(spark, monkeypatch):
    """Texts of every length train the weights, in as many shards as there are documents for; equal rows once."""
    monkeypatch.setattr(scoring, "TRAIN_LEAST", 20)
    monkeypatch.setattr(scoring, "TRAIN_EVERY", 4)
    monkeypatch.setattr(scoring, "SHARD_DOCS", 30)
    monkeypatch.setattr(scoring, "ROUNDS", 1)
    found, real = [], scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, *a, **k: (lambda t: (found.append(t.selectExpr("count(*)", "count(DISTINCT shard)", "max(length(text))").first()) if "shard" in t.columns else None, t)[1])(real(df, *a, **k)))
    for n in (10, 400, 1600):
        rows = spark.range(n).selectExpr("id AS doc_id", "IF(id % 5 > 0, concat('some words ', id), repeat(concat(id, ' long '), 4000)) AS text", "false AS held_out")
        assert scoring.score_documents(rows.unionByName(rows.limit(3))).count() == n + 3
    sizes = [f[0] for f in found]
    assert sizes[0] == 10 and 60 < sizes[1] < 140 and 300 < sizes[2] < 500 and found[0][1] == 1 and found[2][1] > 8
    assert all(f[2] > 20_000 for f in found)


def test_held_out_documents_beat_the_word_counts(spark):
    rng = random.Random(3)
    follow = {w: rng.sample(range(60), 3) for w in range(60)}  # words that have few successors

    def text():
        w, out = rng.randrange(60), []
        for _ in range(rng.choice((20, 40, 80))):
            out.append(f"word{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    rows = [(i, text(), zlib.crc32(str(i).encode()) % 7 == 2) for i in range(700)]
    got = scoring.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean")).where("held_out").collect()
    assert len(got) > 60 and sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.95 * len(got)


def test_quality(docs, rows, empty, spark):
    got = quality.assess(docs).collect()
    assert bag((r.row.doc_id, r.v.n_words, r.v.word_chars, r.v.n_symbols, r.v.n_dup_lines, r.v.n_repeat_words, r.v.base_failed) for r in got) == bag((i, *plain.quality(t)) for i, t, *_ in rows)
    assert not any(r.v.kept and r.v.base_failed for r in got) and quality.assess(empty).count() == 0
    good = "\n".join(f"This is a{i}, and it b{i} has c{i} plain words, d{i} in all." for i in range(16))
    menu, marks = "Home | About | Contact | News", "Buy%%% now### cheap*** $$$ &&& now"
    texts = [good, good + "\n" + menu, good + "\n" + marks, "\n".join([menu + str(i) for i in range(19)]) + "\nA last line of words.", good + "\n\n" + good.split("\n")[0]]
    told = [r.v for r in quality.assess(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).orderBy("row.doc_id").collect()]
    assert [t.kept for t in told] == [True, True, True, False, True]
    assert [t.clean_text for t in told[:3]] == [good] * 3 and told[4].clean_text == good + "\n"
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.v.kept for r in got)


def test_quality_other_scripts(spark):
    """Vowel signs, points and joiners belong to letters; lines of symbols still fail."""
    texts = [
        "यह एक साधारण हिन्दी वाक्य है, जिसमें सभी मात्राएँ सही हैं।\nदिल्ली में आज मौसम बहुत अच्छा है और लोग बाहर घूम रहे हैं।",
        "বাংলাদেশের মানুষ প্রতিদিন সকালে কাজ করতে যায়।\nতারা সন্ধ্যায় বাড়িতে ফিরে পরিবারের সঙ্গে খাবার খায়।",
        "بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ، مَالِكِ يَوْمِ الدِّينِ",
        "e\u0301te\u0301 a\u0300 la re\u0301publique e\u0301tait de\u0301ja\u0300 passe\u0301 et l'e\u0301cole a e\u0301te\u0301 ferme\u0301e",
        " ".join(["=== ~~~ @@@ ^^^ +++ ___"] * 3),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    told = [r.v for r in quality.assess(df).orderBy("row.doc_id").collect()]
    assert [v.kept for v in told] == [True] * 4 + [False]
    assert all(v.clean_text == t and v.clean_words == v.n_words for v, t in zip(told[:4], texts)) and told[4].clean_words == 0


def test_packing(docs, rows, empty, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    long = [(500, "many words, isn't it? " * 60_000, "en", "a"), (501, "z" * 9000, "en", "a")]
    got = packing.pack_documents(docs.unionByName(frame(spark, long))).collect()
    want = collections.Counter()
    for i, t, *_ in rows + long:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048].tobytes()
            want[i, k, s, len(part) // 4, zlib.crc32(part), part] += 1
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    check_places(got)
    assert packing.pack_documents(empty).count() == 0


def check_places(pieces):
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 2048
    return len(by)


def test_packing_plan_is_tight():
    rng = random.Random(1)
    for lengths in ([rng.randint(1, 2048) for _ in range(5000)], [700] * 3000, [1] * 5000, [2048, 1], [1100] * 40 + [948] * 30, [rng.randint(600, 900) for _ in range(900)]):
        counts = dict(collections.Counter(lengths))
        plan = packing.make_plan(counts)
        bins = collections.Counter()
        for length, _, n, first, each, _ in plan.entries:
            for k in range(n):
                bins[first + k // each] += length
        assert sum(e[2] for e in plan.entries) == len(lengths) and max(bins.values()) <= 2048 and len(bins) == plan.sequences
        # first-fit decreasing as the yardstick
        rooms = []
        for x in sorted(lengths, reverse=True):
            at = next((i for i, r in enumerate(rooms) if r >= x), None)
            if at is None:
                rooms.append(2048 - x)
            else:
                rooms[at] -= x
        assert plan.sequences <= 1.01 * len(rooms) + 1


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[10][1]) for i in range(150)] + [(900, None), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (1100, []), (1150, [3.0, -4.0]), (50, vectors[50][1]), (7, vectors[7][1])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id bigint, embedding array<float>, pivot int").repartition(3)
    own = topk.whole_vectors(df)
    got = topk.search(topk.Index(own), own.where("vec_id % 50 = 0")).collect()
    good = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, qv in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted((-int(np.dot(qv[: len(v)], v[: len(qv)])), i) for i, v in good if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = own.where("vec_id IN (50, 51, 52)")
    assert [r["rank"] for r in topk.search(topk.Index(few), few.where("vec_id = 50")).orderBy("rank").collect()] == [1, 2]
    assert topk.search(topk.Index(own.limit(0)), own.limit(0)).count() == 0
    big = np.array([[2**30, 1]]), np.array([[2**28 + 1, 3], [0, 2**27]])
    assert topk.products(*big).tolist() == [[2**58 + 2**30 + 3, 2**27]]


def test_every_training_document_trains_the_weights(spark, monkeypatch):
    from cytomesh.llm import scoring

    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(5)) + f" only{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(scoring, "TRAIN_LEAST", 4)
    monkeypatch.setattr(scoring, "SHARD_DOCS", 8)
    seen = spark.sparkContext.accumulator(0)
    plain = scoring._shard_trainer

    def counted(*a):
        trained = plain(*a)

        def work(shard):
            seen.add(shard.num_rows)
            return trained(shard)

        return work

    monkeypatch.setattr(scoring, "_shard_trainer", counted)
    top = [(f"w{k}".encode(), 20) for k in range(7)]
    scoring.train_model(docs, top, len(rows), len(rows))
    assert seen.value == len(rows)  # each of them once, in one of the rounds
