"""Periodic runs, the positional index and token alignment against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cytomesh.llm import periodic, postings, tokenpairs
from cytomesh.llm.common import table

DOCS = "doc_id bigint, text string, lang string, runs string, row string, segment string, digest string, copies string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = ["the", "The", "one", "of", "réd", "x1", "end.", "half-way", "ﬁ", "漢字", "a", "b"]
    made = [" ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 5, 9, 10, 11, 30, 90)))) for _ in range(60)]
    for i in range(0, 60, 3):  # repeated blocks
        w = made[i].split(" ")
        made[i] = " ".join(w + w[-rng.randrange(1, 6) :] * rng.randrange(2, 9))
    made += [None, "", " \n\t", "word " * 400, "a b " * 100 + "c", LONG, LONG[:5000] + " " + LONG[:5000], "x\x1cy z", "tab\tnew\nline  two", "<s> </s> <|endoftext|> <0x41>", "low ▁ line", ");\rx", "the　wide", "é é é é é é"]
    out = [(i, t) for i, t in enumerate(made)]
    return out + [out[5]] * 30 + [(None, made[7]), (None, None), (3, "another text with a known id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = frame(spark, rows).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --------------------------------------------------------------------------- runs


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(w[s + k] == w[s + k - r] for k in range(r, length)) for r in range(1, q) if q % r == 0):
                out.append((s, length, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_automaton_finds_every_run():
    rng = random.Random(2)
    for _ in range(1500):
        n, k = rng.choice((0, 1, 5, 6, 8, 25, 60)), rng.choice((1, 2, 3, 9))
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 8 else 0):
            a, p = rng.randrange(n), rng.randrange(1, 8)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 9))):
                w[i] = w[i - p]
        want = plain_runs(w)
        assert periodic.runs_of(w) == want
        texts = [[str(x).encode() for x in t] for t in (w, [7], w, [], w[::-1])]
        got = periodic.runs_of_texts(texts)  # filtered first, several texts at once
        assert got[0] == got[2] == want and got[4] == plain_runs(w[::-1]) and got[1] == got[3] == []
        assert periodic.collapsed_words(texts[0], want) == plain_collapse(texts[0], want)


def test_one_word_repeated_is_not_quadratic():
    assert periodic.runs_of([0] * 50_000) == [(0, 50_000, 1)]


def test_automaton_states_and_colours():
    length, link, prefix = periodic.suffix_automaton([0, 1, 0, 1, 1])
    assert [length[p] for p in prefix] == [1, 2, 3, 4, 5] and all(length[link[s]] < length[s] for s in range(1, len(length)))
    paths = periodic.LastOccurrences(link)
    seen = [list(paths.access(s, i)) for i, s in enumerate(prefix)]
    # word 3 closes "0 1", which ended at 1 before
    assert (2, 1) in [(length[x], e) for x, e in seen[3]]


def test_runs_on_tables(docs, rows, empty):
    found = periodic.find_runs(docs)
    assert found.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
    got = collections.Counter((r.doc_id, r.text, tuple(map(tuple, r.runs)), r.collapsed, r.row) for r in found.collect())
    want = collections.Counter()
    for i, t in rows:
        runs = plain_runs(split(t)) if t != LONG else [(0, 30_000, 977)]
        want[i, t, tuple(runs), " ".join(plain_collapse(split(t), runs)), "x"] += 1
    assert got == want
    assert periodic.find_runs(empty).count() == 0


def plain_digest(doc_id, text):
    w = split(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(plain_collapse(w, runs))))


def test_run_query(spark, docs, rows, sf_dir):
    short = [(i, t) for i, t in rows if t != LONG]
    got = periodic.digest(periodic.find_runs(periodic.with_planted_runs(frame(spark, short)))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_digest(i, t) for i, t in short)
    some = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periodic.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(some)
    assert all(got[i] == plain_digest(i, t) for i, t in some if len(t or "") < 6000)


# --------------------------------------------------------------------------- phrases


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_hits(text, items):
    w, hit, named = lowered(text), set(), set()
    for item, t in items:
        p = lowered(t)
        for s in range(max(len(p) - 10, 0) + 1 if p else 0):
            phrase = p[s : s + 10]
            for k in range(len(w) - len(phrase) + 1):
                if w[k : k + len(phrase)] == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    named.add(item)
    return len(w), len(hit), sorted(str(i) for i in named if i is not None)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t in rows if t and t != LONG]
    rng = random.Random(4)
    made = []
    for i in range(25):
        w = rng.choice(texts).split()
        a = rng.randrange(len(w))
        made.append((f"q{i}", " ".join(w[a : a + rng.choice((1, 3, 9, 10, 11, 25))])))
    return made + [("long", " ".join(LONG.split()[500:4000])), ("q1", "The END half"), (None, "one of the"), ("none", None), ("blank", " ."), ("far", "never seen words"), made[0]]


def item_frame(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id string, text string, segment string").repartition(2)


def test_lists_survive_packing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = rng.integers(0, 5, rng.integers(1, 8))
        lists = [np.sort(rng.choice(2**31 if rng.random() < 0.5 else 300, k, replace=False)) for k in counts]
        values = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
        data, ends = postings.packed(values, counts)
        assert (postings.unpacked(data, counts) == values).all() and ends[-1] == len(data)


@pytest.mark.parametrize("segment_words", [1, 200, 1 << 20])
def test_phrases_against_a_scan(spark, docs, rows, items, segment_words):
    index = postings.build(docs, segment_words)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in postings.contamination(index, item_frame(spark, items)).collect())
    memo = {t: plain_hits(t, items) for t in {t for _, t in rows}}
    want = collections.Counter((i, memo[t][0], memo[t][1], tuple(memo[t][2])) for i, t in rows)
    assert got == want


def test_blocks_of_phrases(spark, docs, items, monkeypatch):
    index = postings.build(docs)
    whole = collections.Counter(map(str, postings.contamination(index, item_frame(spark, items)).collect()))
    monkeypatch.setattr(postings, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(postings, "AT_ONCE", 50)
    assert collections.Counter(map(str, postings.contamination(index, item_frame(spark, items)).collect())) == whole


def test_matches_and_proximity(spark, docs, rows, items):
    index = postings.build(docs, 300)
    frame_of = item_frame(spark, items)
    texts = {i: lowered(t) for i, t in rows if i is not None and i != 3}
    for r in postings.find_matches(index, frame_of).collect():  # exact ones are longest stretches of equal words
        if r.doc_id in texts and r.item_id not in (None, "q0", "q1"):
            w, p = texts[r.doc_id], lowered(dict(items)[r.item_id])
            a, b, n = r.start, r.item_start, r.length
            assert w[a : a + n] == p[b : b + n]
            assert a + n == len(w) or b + n == len(p) or w[a + n] != p[b + n]
    few = [(1, "the old grey cat sat on a mat"), (2, "the grey old cat sat down on a mat"), (3, "the cat and the old dog and far from it all a grey mat"), (4, None)]
    index = postings.build(frame(spark, few))
    want = spark.createDataFrame([("i", "old grey cat sat on")], "item_id string, text string")
    hit = lambda slop: {r.doc_id for r in postings.find_matches(index, want, slop).collect()}
    assert hit(0) == {1} and hit(1) == {1, 2}
    with pytest.raises(ValueError):
        postings.find_matches(index, want, postings.MARGIN)


def test_phrases_of_nothing(spark, docs, rows, empty, items):
    assert postings.contamination(postings.build(empty), item_frame(spark, items)).count() == 0
    none = item_frame(spark, items).where("false")
    index = postings.build(docs)
    assert {(r.n_hit, len(r["items"])) for r in postings.contamination(index, none).collect()} == {(0, 0)}
    assert postings.contamination(index, none).count() == len(rows) and postings.find_matches(index, none).count() == 0


# --------------------------------------------------------------------------- tokens


def plain_alignment(rows):
    a = tokenpairs.Aligner(*tokenpairs.tokenizer_paths())
    letters = tokenpairs._byte_letters()
    vocabulary = {i: t for t, i in a.a.get_vocab().items()}
    cut, count = [], collections.Counter()
    for _, t in rows:
        if not t:
            cut.append(None)
            continue
        ids_a, ids_b = a.a.encode(" " + t, add_special_tokens=False).ids, a.b.encode(t)
        bytes_a = [bytes(letters[c] for c in vocabulary[i]) for i in ids_a]
        bytes_b = [bytes([int(a.b.id_to_piece(i)[3:5], 16)]) if a.b.is_byte(i) else a.b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            cut.append(None)
            continue
        ends_a = dict(zip(np.cumsum(list(map(len, bytes_a))).tolist(), range(len(ids_a))))
        ends_b = dict(zip(np.cumsum(list(map(len, bytes_b))).tolist(), range(len(ids_b))))
        both = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in both]
        count.update(links)
        groups, x, y = [], 0, 0
        for e in both:
            groups.append(",".join(map(str, ids_a[x : ends_a[e] + 1])) + "|" + ",".join(map(str, ids_b[y : ends_b[e] + 1])))
            x, y = ends_a[e] + 1, ends_b[e] + 1
        cut.append((len(ids_a), len(ids_b), groups, links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), c in zip(rows, cut):
        if c is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = c
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("head", [tokenpairs.HEAD_PAIRS, 5])
def test_alignment_against_whole_texts(docs, rows, empty, head, monkeypatch):
    monkeypatch.setattr(tokenpairs, "HEAD_PAIRS", head)  # with 5, nearly all pairs go through the shuffle
    assert collections.Counter(map(tuple, tokenpairs.align_documents(docs).collect())) == collections.Counter(plain_alignment(rows))
    assert tokenpairs.align_documents(empty).count() == 0


def test_alignment_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, tokenpairs.op13_token_alignment(spark, sf_dir).collect())) == collections.Counter(plain_alignment(rows))


def test_stretches_equal_whole_texts():
    a = tokenpairs.Aligner(*tokenpairs.tokenizer_paths())
    assert not a.whole
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "\r\n", ".", "'s", "é", "漢", "▁", "<0x41>", "<s>", "\x1c", "\xa0", "　", "12", "\x00", "😀", "İ", ");\r", "}", "\x85", " \n", "é", "​"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        want = a.align((" " + s).encode(), a.a.encode(" " + s, add_special_tokens=False).ids, a.b.encode(s))
        got = a.texts([s])[0]
        assert (got is None) == (want is None)
        assert got is None or got == (want[0], want[1], hashlib.sha256(want[2]).hexdigest(), want[3])


def test_ranks_agree_only_with_plain_merges(tmp_path):
    import json

    path = tokenpairs.tokenizer_paths()[0]
    assert tokenpairs.ranks_agree(path)
    spec = json.load(open(path, encoding="utf-8"))
    spec["model"]["merges"][0], spec["model"]["merges"][40] = spec["model"]["merges"][40], spec["model"]["merges"][0]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    assert not tokenpairs.ranks_agree(str(tmp_path / "other.json"))
