"""Periodic runs of words: stretches that repeat one block of words at least four times over.

A suffix automaton of the words has one path per prefix in its tree of suffix links. Appending word i recolours the path
of its prefix with i: that is the access of a link-cut forest, whose paths hold the states with one last occurrence.
A path piece that carried the colour e until now, and reaches down to a state of length L, says that the last L words
ended at e before and no longer suffix did. So the words from e - L + 1 to i have period i - e, and cannot be extended to
the left; where L >= i - e they hold a square. A run shows up with its smallest period at each of its later words, so the
last word at which (start, period) is seen ends it.

Most words of ordinary texts cannot lie in such a run: three words in a row inside one are met at least three times in it.
Only maximal stretches of words for which that holds (by hashes, so possibly too many) are handed to the automaton.

Defined results: null and empty texts have no words and no runs. Repeated rows and ids are treated each for itself. Very
long texts are read whole. Empty tables give empty results. Columns other than the results keep their names and values;
an input column called ``runs`` or ``collapsed`` is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import table

#: A run repeats its block so often at least, and has so many words.
REPEATS, LEAST_WORDS = 4, 6
#: Words that are filtered together; one longer text is read alone.
WORDS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 500
FILTER_ROUNDS = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII characters of white space


# --------------------------------------------------------------------------- the automaton and its paths


def suffix_automaton(word_ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Lengths and suffix links of the states (0: the start), and the state of every prefix."""
    after: list[dict[int, int]] = [{}]
    length, link, prefix = [0], [-1], []
    last = 0
    for i, c in enumerate(word_ids):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        after.append({})
        prefix.append(new)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                after.append(dict(after[q]))
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return length, link, prefix


class LastOccurrences:
    """A link-cut forest over suffix links. Every path is a splay tree ordered by depth; its root knows the path's colour,
    the last end of the words that its states stand for. The start state 0 stands for no node."""

    def __init__(self, link: list[int]):
        self.up = [max(p, 0) for p in link]
        self.left = [0] * len(link)
        self.right = [0] * len(link)
        self.colour = [-1] * len(link)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:  # p was the root of its path
            self.colour[x] = self.colour[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Colour the path from ``state`` to the start with ``end``; yields (deepest state, old colour) of its old pieces."""
        x, below = state, 0
        while x:
            self._splay(x)
            deeper = self.right[x]
            if deeper:
                self.colour[deeper] = self.colour[x]
            if self.colour[x] >= 0:
                yield x, self.colour[x]
            self.right[x] = below
            below, x = x, self.up[x]
        if below:
            self.colour[below] = end


def runs_of(word_ids: list[int], repeats: int = REPEATS, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    length, link, prefix = suffix_automaton(word_ids)
    paths = LastOccurrences(link)
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        for piece, e in paths.access(state, i):
            period, same = i - e, length[piece]
            if same >= (repeats - 1) * period and same + period >= least:
                ends[e - same + 1, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


# --------------------------------------------------------------------------- where runs can lie


def candidate_stretches(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (first word, word after the last) of the stretches that can hold runs. ``owner`` numbers the texts, in order.

    A run of at least 4 periods and 6 words holds each of its word triples three times, and at least four triples. So
    does the stretch of such triples around it; the test is repeated inside the stretches it leaves.
    """
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.empty(0, np.int64)
    triple = hashes[at] * np.uint64(0x9E3779B97F4A7C15) + (hashes[at + 1] if len(at) else hashes[:0]) * np.uint64(0xC2B2AE3D27D4EB4F)
    triple ^= triple >> np.uint64(29)
    triple += hashes[at + 2] if len(at) else hashes[:0]
    inside = owner[at] if len(at) else owner[:0]
    for _ in range(FILTER_ROUNDS):
        if not len(at):
            break
        key = (triple ^ (inside.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        ordered = np.sort(key)
        thrice = np.unique(ordered[2:][ordered[2:] == ordered[:-2]])
        found = np.searchsorted(thrice, key)
        often = np.zeros(len(at), bool) if not len(thrice) else thrice[np.minimum(found, len(thrice) - 1)] == key
        before = len(at)
        at, triple, inside = at[often], triple[often], inside[often]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(inside.astype(np.int64)) != 0)
        inside = np.cumsum(fresh)
        enough = np.bincount(inside, minlength=1)[inside] >= LEAST_WORDS - 2
        at, triple, inside = at[enough], triple[enough], inside[enough]
        if len(at) == before:
            break
    if not len(at):
        return np.empty((0, 2), np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(inside.astype(np.int64)) != 0]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return np.stack([at[first], at[last] + 3], axis=1)


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(starts[-1])).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in candidate_stretches(hashes, owner).tolist():
        k = int(owner[a])
        shift = a - int(starts[k])
        known: dict[bytes, int] = {}
        ids = [known.setdefault(w, len(known)) for w in texts[k][shift : b - int(starts[k])]]
        out[k] += [(shift + s, n, q) for s, n, q in runs_of(ids)]
    return [sorted(r) for r in out]


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


# --------------------------------------------------------------------------- on tables


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without the
    repeats, its words joined by one space. No shuffle: a text is read whole by the task that holds it."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = runs_of_texts(texts)
            left = [b" ".join(collapsed_words(w, r)) for w, r in zip(texts, runs, strict=True)]
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()), fields)
            collapsed = pa.array(left, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([part.column("row"), lists, collapsed], ["row", "runs", "collapsed"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts: list[list[bytes]] = []
                first = held = 0
                for i, t in enumerate(part.column("text").to_pylist()):
                    texts.append(words_of(t))
                    held += len(texts[-1])
                    if held >= WORDS_AT_ONCE:
                        yield done(part.slice(first, len(texts)), texts)
                        first, held, texts = i + 1, 0, []
                if texts:
                    yield done(part.slice(first, len(texts)), texts)

    source = docs.select(own, F.col(f"`{text}`").alias("text"))
    found = source.mapInArrow(find, source.select("row", F.lit(None).cast(RUNS).alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema)
    keep = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("runs", "collapsed")]
    return found.select(*keep, "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null without runs."""
    none = F.lit(None).cast(RUNS.removeprefix("array<").removesuffix(">"))
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs`` the columns of the query."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the ids (by checksum) repeat a block of their own words from some word on."""

    def planted(doc_id: int | None, text: str | None) -> str | None:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        words = words_of(text) if h % 10 == 0 else []
        if not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        block = words[a : a + p]
        return b" ".join((words[:a] + block * (-(-(n - a) // p)))[:n]).decode("utf-8", "surrogatepass")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, texts = (c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(list(map(planted, ids, texts)), pa.string())], ["doc_id", "text"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(plant, "doc_id bigint, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
