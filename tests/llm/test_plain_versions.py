"""Line rules, language prediction, copies and slots against plain versions written from their definitions."""

import collections
import re
import sys
from pathlib import Path

import numpy as np
import pytest
import regex

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain
from test_small import DOCS, EN, FR, corpus, frame

import corpus_pipeline
from cytomesh.llm import langid, mixing, quality, sharding
from cytomesh.llm.common import table, written

GOOD = "\n".join(f"This is a{i}, and it b{i} has c{i} plain words, d{i} in all." for i in range(16))
SCRIPTS = [
    "यह एक साधारण हिन्दी वाक्य है, जिसमें सभी मात्राएँ सही हैं।\n\nदिल्ली में आज मौसम बहुत अच्छा है और लोग बाहर घूम रहे हैं।",
    "বাংলাদেশের মানুষ প্রতিদিন সকালে কাজ করতে যায়।\nতারা সন্ধ্যায় বাড়িতে ফিরে পরিবারের সঙ্গে খাবার খায়।",
    "بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ، مَالِكِ يَوْمِ الدِّينِ",
    "été à la république était déjà passé et l'école a été fermée",
    "天気 が いい ので、 今日 は みんな で 公園 に 行き ました 。 とても 楽しかった です 。",
    " ".join(["=== ~~~ @@@ ^^^ +++ ___"] * 3),
]
LINES = ["Home | About | Contact | News", "Buy%%% now### cheap*** $$$ &&& now", "Please click here", "a long sentence that goes on to say click here " * 3, "", "  ", "\t", "x\u2028y", GOOD.split("\n")[0], "=== ~~~ @@@", "one · two · three", "|", "wow!! yes?? no## a%%", "ends in!! \t", "half ~~ @", "é – “quoted” ’tis"]


def line_ok(line):
    """The rules of a line with words, from the docstring of the module."""
    w = plain.words(line)
    odd = regex.sub(r"[\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'\"()\-–—’“”«»¿¡‌‍" + quality.SCRIPT_MARKS + "]", "", line)
    if len(line) - len(odd) < len(line) * (1 - quality.MARKS_SHARE):
        return False
    if 2 * len(re.findall(r"[!?*#$%&]{2,}(?=[\x20\x09-\x0D]|$)", line)) > len(w):
        return False
    bars = sum(p in "|»›·•" and len(p) == 1 for p in re.split(r"[\x20\x09]", line))
    if bars and bars * quality.BAR_WORDS >= len(w):
        return False
    return not (len(w) < quality.BOILERPLATE_WORDS and any(b in line.lower() for b in quality.BOILERPLATE))


def line_first(text):
    """kept, clean text."""
    text, seen, left = text or "", set(), []
    for line in text.split("\n"):
        if not plain.words(line):
            left.append(line)
        elif line not in seen:
            seen.add(line)
            if line_ok(line):
                left.append(line)
    clean = "\n".join(left)
    return not plain.quality(text)[-1] and len(plain.words(clean)) >= len(plain.words(text)) * quality.KEEP_SHARE, clean


def mixed_texts():
    rng = np.random.default_rng(4)
    made = [GOOD, GOOD.replace("\n", "\n\n"), "p0 a b c d e f g h\n\np1 i j k l m n o p\n\n\n\np2 q r s t u v w x", *SCRIPTS, None, "", "\n\n\n", " \n\t\n"]
    for _ in range(150):
        pool = [*LINES, *GOOD.split("\n")]
        made.append("\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 24))))
    return made


def test_line_rules(spark):
    texts = mixed_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, v string").repartition(3)
    got = {r.row.doc_id: (r.v.kept, r.v.clean_text) for r in quality.assess(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == line_first(t), t
    assert got[2][1] == texts[2]  # paragraphs stay apart
    kept = {r.doc_id: r for r in quality.kept_rows(df).collect()}
    assert kept.keys() == {i for i, g in got.items() if g[0]} and all(r.text == got[i][1] for i, r in kept.items())


def test_sql_of_line_rules(spark, tmp_path):
    """The SQL twin agrees on texts of other scripts, decomposed letters and blank lines."""
    import duckdb

    texts = mixed_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quality.QUALITY_SQL}) ORDER BY doc_id").fetchall()
    got = sorted(tuple(r[n] for n in names) for r in quality.op8_quality_rules(spark, str(tmp_path)).collect())
    assert got == want


def test_quality_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    after = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()}
    want = {r.doc_id: line_first(r.text) for r in docs.collect()}
    assert after == {i: clean for i, (kept, clean) in want.items() if kept}


# --------------------------------------------------------------------------- languages


def letter_triples(text):
    out = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        codes = [0, *map(ord, word), 0]
        out.update(zip(codes, codes[1:], codes[2:]))
    return out


def bundle(counts):
    zero = np.zeros(langid.DIMENSIONS)
    return sum((n * np.roll(langid._letter(a), 2).astype(float) * np.roll(langid._letter(b), 1) * langid._letter(c) for (a, b, c), n in counts.items()), zero)


def plain_languages(labelled, texts):
    """lang_pred, score of every text, from one bundle a language and one a text."""
    sums = collections.defaultdict(collections.Counter)
    for t, lang in labelled:
        if lang is not None:
            sums[lang] += letter_triples(t)
    known = {lang: bundle(c) for lang, c in sorted(sums.items()) if c}
    out = {}
    for t in set(texts):
        counts = letter_triples(t)
        if not counts or not known:
            out[t] = ("und", 0.0)
            continue
        v = bundle(counts)
        cosines = {lang: round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 5) for lang, p in known.items()}
        best = max(sorted(cosines), key=lambda x: cosines[x])
        out[t] = (best, min(1.0, max(0.0, cosines[best])))
    return out


def check_languages(got, want):
    """Equal languages and scores, but for rounding in the last place."""
    for text, pred, score in got:
        lang, s = want[text]
        assert score == pytest.approx(s, abs=2e-5), text
        assert pred == lang or abs(score - s) <= 2e-5 and score > 0, text


def test_predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.collect()
    held = {r.doc_id: r.held_out for r in langid.op4_language_id(spark, sf_dir).collect()}
    learn = [(r.text, r.lang) for r in rows if not held[r.doc_id]]
    want = plain_languages(learn, [r.text for r in rows])
    texts = {r.doc_id: r.text for r in rows}
    got = langid.op4_language_id(spark, sf_dir).collect()
    check_languages([(texts[r.doc_id], r.lang_pred, r.score) for r in got], want)


def test_predictions_of_odd_texts(spark):
    rows = corpus()
    docs = frame(spark, rows)
    labelled = [(EN, "en"), (FR, "fr"), (SCRIPTS[0], "hi"), (None, "fr"), ("12", "de"), ("x", None)]
    learned = langid.profiles(spark.createDataFrame(labelled, "text string, lang string"))
    want = plain_languages(labelled, [r[1] for r in rows])
    check_languages([(r.text, r.lang_pred, r.score) for r in langid.predict(docs, learned).collect()], want)


def test_language_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    want = plain_languages([(r.text, r.lang) for r in rows], [r.text for r in rows])
    after = {r.doc_id: r for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    for r in rows:
        pred, score = want[r.text]
        if abs(score - corpus_pipeline.MIN_COSINE) > 2e-5:
            assert (r.doc_id in after) == (pred != "und" and score >= corpus_pipeline.MIN_COSINE)
    assert all(a.lang is not None and a.text == r.text and a.lang in (r.lang, want[r.text][0]) for r in rows if (a := after.get(r.doc_id)))


# --------------------------------------------------------------------------- copies and slots


def test_no_document_is_mixed_more_often_than_the_limit(spark):
    rows = [(1, "a b c d", "s"), (2, "", "s"), (3, None, "s"), (4, "e f g h", "s"), (5, "w " * 400, "big"), (6, " ", None)]
    df = spark.createDataFrame([(i, t, None, s, *["x"] * 7) for i, t, s in rows], DOCS)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert max(copies.values()) <= 2 and copies[1] == copies[4] == 2
    assert max(collections.Counter(r.doc_id for r in mixing.mixed_rows(df).collect()).values()) <= 2


def test_rows_without_id_are_spread_inside_their_shard(spark):
    df = spark.range(20_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('text ', id) AS text")
    same = spark.range(1000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'one text' AS text")
    rows = sharding.shard_slots(df.unionByName(same)).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(21_000))
    F = sharding.F
    order = df.select(sharding.mixed31(F.col("doc_id"), F.octet_length("text").cast("bigint"), F.crc32("text")).alias("o"))
    parts = order.groupBy(F.shiftright("o", 27)).count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 2000
    written(df.limit(0))
