"""The stages of the pipeline, each held against a plain version on its own input."""

import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain
from test_small import check_places

import corpus_pipeline
from cytomesh.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        out[name] = (before.collect(), docs.collect(), docs.columns)
    return out


def test_columns(stages):
    assert all(cols == ["doc_id", "text", "lang", "source", "n_chars"] for name, (_, _, cols) in stages.items() if name != "packing")


def test_language(stages):
    before, after, _ = stages["language"]
    kept = {r.doc_id for r in after}
    assert all(any(c.isalpha() for c in r.text) for r in after)
    assert all(r.doc_id in kept for r in before if r.text and len(plain.words(r.text)) >= 10)


def test_quality(stages):
    before, after, _ = stages["quality"]
    texts = {r.doc_id: r.text for r in before}
    assert not any(plain.quality(texts[r.doc_id])[-1] for r in after)
    assert all(set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n")) and r.n_chars == len(r.text) for r in after)
    assert len(after) > 0.8 * len(before)


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before]
    want = {i for (i, _), c in zip(rows, plain.near_duplicates(rows)) if c is None or i == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_mixing(stages):
    before, after, _ = stages["mixing"]
    size, _, taken = plain.mix([(r.doc_id, r.text, r.source) for r in before])
    times = collections.Counter(r.doc_id for r in after)
    assert all(times[r.doc_id] * n == k for r, n, k in zip(before, size, taken))


def test_packing(stages):
    before, after, _ = stages["packing"]
    whole = collections.Counter()
    for r in after:
        whole[r.doc_id] += r.piece == 0
    assert whole == collections.Counter(r.doc_id for r in before)
    assert check_places(after) <= 1.05 * sum(r.length for r in after) / 2048 + 2


def test_run_and_empty(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == len(stages["packing"][1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.count() == 0
