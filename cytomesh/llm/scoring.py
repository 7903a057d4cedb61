"""Log-likelihood of complete documents under a gated recurrent word model.

1. One pass deals the documents into chunks of bounded size and counts the words of every chunk.
2. Counts meet by word, over all training documents, and every chunk gets back the totals of its own words.
3. The most frequent words are listed (a fixed number). The recurrent model is trained in tasks, on all training
   documents, whole and however long: in every round each shard of some thousand documents goes on from the common weights,
   and these become the mean over the shards, by tokens. The documents are dealt over the rounds by the hash of id and
   text, so each is learned from once; those of a small corpus are in several rounds.
4. A task reads a chunk's totals, then its documents, all in step; the state goes from window to window to the end.

Defined results: null and empty texts consist of the closing token. Rows with a null id are training rows. Repeated rows
count, and are scored, each for itself. Without training documents every token has probability 1 and known words are
none. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.llm.common import crc32_of, delete, table, written
from cytomesh.llm.recurrent import CLASS_WORDS, CLASSES, RATE, GatedModel

#: Fixed by the task.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 12 << 20
LISTED = CLASSES * CLASS_WORDS - 1  # and the closing token
#: One of so many training documents trains the recurrent weights: each of them.
TRAIN_EVERY = 1
#: Documents of a round at least, while there are; a corpus of fewer for all rounds repeats them.
TRAIN_LEAST = 512
#: Documents of a shard, rounds over all shards, and what a round's rate is to that of the one before.
SHARD_DOCS, ROUNDS, SLOWER = 4096, 3, 0.5
#: Weights that are summed together.
WEIGHTS_PART = 16_384

CHUNKED = "kind int, chunk bigint, doc_id bigint, held_out boolean, text binary, word binary, n bigint"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def tokens(lowered: bytes) -> list[bytes]:
    return lowered.split()  # at the six ASCII characters of white space


def deal(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: 0 a word of a chunk and its count in training rows, 1 a document of a chunk, in lower case."""
    from pyspark import TaskContext

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        counts: Counter = Counter()

        def block(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            types = {"kind": pa.int32(), "chunk": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "text": pa.binary(), "word": pa.binary(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], list(types))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, size
            items = list(counts.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield block(kind=[0] * len(part), chunk=[chunk] * len(part), word=[w for w, _ in part], n=[c for _, c in part])
            counts.clear()
            chunk, size = chunk + 1, 0

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, held = part.column("doc_id").to_pylist(), part.column("held_out").to_pylist()
                texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in part.column("text").to_pylist()]  # A-Z only: these are bytes
                first = 0
                for i, text in enumerate(texts):
                    if held[i]:
                        counts.update(dict.fromkeys(tokens(text), 0))
                    else:
                        counts.update(tokens(text))
                    size += len(text)
                    if size >= CHUNK_BYTES or i + 1 == len(texts):
                        own = slice(first, i + 1)
                        yield block(kind=[1] * (i + 1 - first), chunk=[chunk] * (i + 1 - first), doc_id=ids[own], held_out=held[own], text=texts[own])
                        first = i + 1
                    if size >= CHUNK_BYTES:
                        yield from flush()
        yield from flush()

    return written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text").mapInArrow(dealt, CHUNKED), by=["kind"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, tokens, v: the weighted sums of all rows of a part."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for part, tokens_, v in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "v")), strict=True):
            n, old = sums.get(part, (0, 0.0))
            sums[part] = (n + tokens_, old + np.frombuffer(v))
    if sums:
        rows = sorted(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.int64()), pa.array([r[1][1].tobytes() for r in rows], pa.binary())], ["part", "tokens", "v"])


def _shard_trainer(handed, end: int, rate: float):
    """A function of the documents of one shard: the weights after a pass over them, times their tokens, part by part."""

    def trained(rows):
        model, ids = handed.value
        own = GatedModel.__new__(GatedModel)
        own.listed, own.classes, own.p = model.listed, model.classes, {k: v.copy() for k, v in model.p.items()}
        texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in rows.column("text").to_pylist()]
        n = own.train([np.array([ids.get(w, own.listed) for w in tokens(t)] + [end]) for t in texts], rate)
        flat = own.weights() * n
        parts = [flat[a : a + WEIGHTS_PART].tobytes() for a in range(0, len(flat), WEIGHTS_PART)]
        return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "tokens": pa.array([n] * len(parts), pa.int64()), "v": pa.array(parts, pa.binary())})

    return trained


def train_model(docs: DataFrame, top: list[tuple[bytes, int]], ends: int, rest: int) -> tuple[GatedModel, dict[bytes, int], int]:
    """The model, ids of listed words, and the id of the closing token. ``docs``: training rows (doc_id, text), ``ends`` of them."""
    ranked = sorted([*top, (None, ends)], key=lambda x: (-x[1], x[0] or b""))
    ids = {w: i for i, (w, _) in enumerate(ranked)}
    end = ids.pop(None)
    model = GatedModel(np.array([c for _, c in ranked], float), float(rest))
    every = max(1, min(TRAIN_EVERY, ends // TRAIN_LEAST))
    parts = min(ROUNDS, max(1, ends // (every * TRAIN_LEAST)))
    shards = max(1, -(-ends // (every * parts * SHARD_DOCS)))
    turns: dict[int, DataFrame] = {}
    h = F.xxhash64("doc_id", "text")
    schema = "part int, tokens bigint, v binary"
    for r in range(ROUNDS):
        handed = docs.sparkSession.sparkContext.broadcast((model, ids))  # of fixed size

        if r < parts:  # equal rows train once, so no shard holds the copies of a row
            chosen = docs.where(F.pmod(h, F.lit(every * parts)) == every * r).select(F.pmod(F.xxhash64(h), F.lit(shards)).alias("shard"), "doc_id", "text")
            turns[r] = written(chosen.repartition(shards, "shard").distinct().select("shard", "text"))
        # one model a task leaves it; the sums of a part meet in a stream
        apart = turns[r % parts].repartition(4 * shards, "shard")  # so that few shards share a task
        models = apart.groupBy("shard").applyInArrow(_shard_trainer(handed, end, RATE * SLOWER**r), schema).mapInArrow(summed, schema)
        rows = models.repartition("part").mapInArrow(summed, schema).orderBy("part").collect()  # of fixed size
        if not rows:
            break
        model.set_weights(np.concatenate([np.frombuffer(x["v"]) for x in rows]) / rows[0]["tokens"])
        handed.unpersist()
        if r + parts >= ROUNDS:
            delete(turns.pop(r % parts))
    for left in turns.values():
        delete(left)
    return model, ids, end


def score_documents(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, held_out) scored; see SCORED, and train_tokens."""
    spark = docs.sparkSession
    dealt = deal(docs)
    words = dealt.where("kind = 0").select("chunk", "word", "n")
    by_word = W.partitionBy("word")  # one row a chunk at most
    totals = words.select("chunk", "word", F.sum("n").over(by_word).alias("c"), (F.min("chunk").over(by_word) == F.col("chunk")).alias("once"))
    totals = written(totals)
    ends = dealt.where("kind = 1 AND NOT held_out").count()
    seen = totals.where("once AND c > 0")
    n_words, n_types = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, types = n_words + ends, n_types + (ends > 0)
    # only counts that can be among the largest reach the driver: those from the power of two on that enough words have
    powers = {r["k"]: r["n"] for r in seen.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = max((k for k in powers if sum(n for j, n in powers.items() if j >= k) >= LISTED), default=0)
    often = seen.where(F.col("c") >= 2**least)
    top = [(bytes(r["word"]), r["c"]) for r in often.orderBy(F.col("c").desc(), "word").limit(LISTED).collect()]
    rest_words, rest_types = n_words - sum(c for _, c in top), n_types - len(top)
    training = docs.where("NOT held_out").select("doc_id", "text")
    model, ids, end = train_model(training, top, ends, rest_words) if ends else (None, {}, 0)
    handed = spark.sparkContext.broadcast((model, ids))  # of fixed size
    ln10 = float(np.log(10.0))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = handed.value
        chunk, known = None, {}
        counts: list[np.ndarray] = []
        waiting: list[tuple] = []

        def finish() -> pa.RecordBatch:
            c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            base = np.log10((c + 1) / (n_all + types + 1))
            base_end = float(np.log10((ends + 1) / (n_all + types + 1)))
            listed = np.full(len(c), model.listed if model else 0)
            if model:
                for w, i in ids.items():
                    if w in known:
                        listed[known[w]] = i
            # share of a word among those that are not listed, with one place for words never seen
            share = np.where(listed == model.listed, np.log((c + 1) / (rest_words + rest_types + 1)), 0.0) if model else np.zeros(len(c))
            at = [np.array(list(map(known.__getitem__, tokens(t))), dtype=np.int64) for _, _, t in waiting]
            score = model.score([np.append(listed[a], end) for a in at]) if model else np.zeros(len(at))
            rows = {
                "doc_id": pa.array([w[0] for w in waiting], pa.int64()), "held_out": pa.array([w[1] for w in waiting], pa.bool_()),
                "n_tokens": pa.array([len(a) + 1 for a in at], pa.int64()), "n_known": pa.array([int((c[a] > 0).sum()) + (ends > 0) for a in at], pa.int64()),
                "base_score": pa.array([float(base[a].sum()) + base_end for a in at], pa.float64()),
                "score": pa.array([(float(s) + float(share[a].sum())) / ln10 for s, a in zip(score, at, strict=True)], pa.float64()),
            }
            waiting.clear()
            return pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

        for batch in batches:
            keys = batch.column("chunk").to_numpy()
            for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(keys)) + 1):
                if not len(cut):
                    continue
                part = batch.slice(int(cut[0]), len(cut))
                if keys[cut[0]] != chunk:
                    if waiting:
                        yield finish()
                    chunk, known = keys[cut[0]], {}
                    counts.clear()
                own = part.filter(pa.compute.equal(part.column("kind"), 0))
                known.update(zip(own.column("word").to_pylist(), range(len(known), len(known) + own.num_rows), strict=True))
                counts.append(own.column("c").to_numpy(zero_copy_only=False))
                docs_ = part.filter(pa.compute.equal(part.column("kind"), 1))
                waiting += zip(*(docs_.column(x).to_pylist() for x in ("doc_id", "held_out", "text")), strict=True)
        if waiting:
            yield finish()

    none = lambda t, c: F.lit(None).cast(t).alias(c)
    lists = totals.select("chunk", F.lit(0).alias("kind"), "word", "c", none("bigint", "doc_id"), none("boolean", "held_out"), none("binary", "text"))
    texts = dealt.where("kind = 1").select("chunk", F.lit(1).alias("kind"), none("binary", "word"), none("bigint", "c"), "doc_id", "held_out", "text")
    # as many tasks as chunks, so none grows with the corpus
    chunks = dealt.where("kind = 1").agg(F.count_distinct("chunk")).first()[0]
    both = lists.unionByName(texts).repartition(max(chunks, 1), "chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(scored, SCORED).withColumn("train_tokens", F.lit(n_all).cast("bigint"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
