"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. The vector of three neighbouring letters is
bound from them: the first letter's vector rotated by two places times the second's rotated by one times the third's.
A document, and a language, is the bundle (sum) of the vectors of its letter triples, in lower case, words bounded by a
blank. The language whose bundle has the largest cosine with the document's is the prediction.

The bundle of a language is the sum over its triples of count times vector, so all labelled documents are counted in one
pass and only counts are shuffled; their vectors are added up in tasks.

Defined results: null texts and texts without a letter give ``und`` and score 0, as does every text when nothing was
learned. Equal cosines go to the smaller language. Repeated rows count, and are predicted, each for itself. Very long
texts are counted in parts. ``predict`` keeps all input columns but ``lang_pred`` and ``score``, which it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import crc32_of, table

#: Length of the vectors, and the seed of the letters'.
DIMENSIONS = 2048
SEED = 20
UNKNOWN = "und"
#: Code points of a text that are counted at a time.
PART = 1 << 20
#: Triples that a task counts before it sends partial sums on.
COUNTED = 500_000
#: Texts whose bundles are made by one matrix product.
BUNDLED = 128
#: Fixed by the task: share of the documents that is held out.
FOLDS, HELD_OUT = 3, 1

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point itself for letters, 0 for the rest."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)
    return _letters


def triples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter triples, as packed code points, and their counts; empty for a text without letters."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.zeros(1, dtype=np.uint64)
    for at in range(0, len(text), PART):
        last = at + PART >= len(text)
        raw = text[at : at + PART].lower().encode("utf-32-le", "surrogatepass")
        codes = np.concatenate([tail, _letter_table()[np.frombuffer(raw, dtype="<u4")].astype(np.uint64), np.zeros(int(last), np.uint64)])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one blank between words
        tail = codes[-2:]
        if len(codes) >= 3:
            packed = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
            middle = codes[1:-1] != 0
            found.append(np.unique(packed[middle], return_counts=True))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)


def _letter(code: int) -> np.ndarray:
    if code not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[code] = (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.float32)
    return _vectors[code]


def triple_vectors(packed: np.ndarray) -> np.ndarray:
    """Bound vectors of packed triples, one a row."""
    parts = [(packed >> np.uint64(s) & np.uint64(0x1FFFFF)).astype(np.int64) for s in (42, 21, 0)]
    codes, where = np.unique(np.concatenate(parts), return_inverse=True)
    letters = np.stack([_letter(int(c)) for c in codes])
    a, b, c = np.split(where, 3)
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def count_triples(labelled: DataFrame) -> DataFrame:
    """lang, triple, n over all rows of (text, lang)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], int] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"lang": [k[0] for k in sums], "triple": [k[1] for k in sums], "n": list(sums.values())})
            sums.clear()
            return out

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                part: list[str] = []
                size = 0
                for text in [*texts, None]:
                    if text is not None:
                        part.append(text)
                        size += len(text)
                    if part and (text is None or size > PART // 2):
                        for key, n in zip(*(x.tolist() for x in triples("\n".join(part))), strict=True):
                            sums[lang, key] = sums.get((lang, key), 0) + n
                        part, size = [], 0
            if len(sums) > COUNTED:
                yield flush()
        if sums:
            yield flush()

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows.mapInPandas(counted, "lang string, triple bigint, n bigint").groupBy("lang", "triple").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit vector of every language. The driver gets one vector a language and task, however many documents there are."""

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                for at in range(0, len(own), 4096):
                    part = own.iloc[at : at + 4096]
                    grown = part["n"].to_numpy(np.float64) @ triple_vectors(part["triple"].to_numpy().astype(np.uint64)).astype(np.float64)
                    sums[lang] = sums.get(lang, 0.0) + grown
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(len(v)), "x": v})

    parts = count_triples(labelled).mapInPandas(bundled, "lang string, dim int, x double")
    summed = parts.groupBy("lang", "dim").agg(F.sum("x").alias("x"))  # whole numbers: any order gives the same sum
    out: dict[str, np.ndarray] = {}
    for r in summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v")).orderBy("lang").toLocalIterator():
        v = np.array([e["x"] for e in r["v"]])
        if np.linalg.norm(v) > 0:
            out[r["lang"]] = (v / np.linalg.norm(v)).astype(np.float32)
    return out


def predict(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine with the predicted language's profile, at least 0."""
    langs = sorted(learned)
    matrix = np.stack([learned[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS), np.float32)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    handed = docs.sparkSession.sparkContext.broadcast(matrix)  # languages x DIMENSIONS numbers

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [triples(t or "") for t in texts]
        lens = np.array([len(k) for k, _ in found])
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not langs or not lens.any():
            return pred, score
        keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        rows = np.repeat(np.arange(len(texts)), lens)
        counts = np.concatenate([c for _, c in found]).astype(np.float32)
        bundles = np.zeros((len(texts), DIMENSIONS), np.float32)
        for at in range(0, len(keys), 8192):
            own = (where >= at) & (where < at + 8192)
            dense = np.zeros((len(texts), min(8192, len(keys) - at)), np.float32)
            dense[rows[own], where[own] - at] = counts[own]
            bundles += dense @ triple_vectors(keys[at : at + 8192])
        norms = np.linalg.norm(bundles, axis=1)
        cosines = np.round((bundles @ handed.value.T) / np.maximum(norms, 1e-30)[:, None], 5)
        best = cosines.argmax(axis=1)
        for i in np.flatnonzero(lens):
            pred[i], score[i] = langs[best[i]], float(min(1.0, max(0.0, cosines[i, best[i]])))
        return pred, score

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BUNDLED):
                part = batch.slice(at, BUNDLED)
                pred, score = judge(part.column("text").to_pylist())
                arrays = [part.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(predicted, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) == HELD_OUT)
    learned = profiles(docs.where("NOT held_out"))
    texts = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return predict(texts, learned).select("doc_id", "held_out", "lang_pred", "score")
