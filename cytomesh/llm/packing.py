"""Best-fit packing of tokenized documents by linear grouping.

1. Documents become token ids; those longer than a sequence are cut into whole pieces and a rest.
2. Piece lengths are counted. There are at most 2,048 different lengths whatever the input, so the plan is made from the
   counts alone: lengths above an eighth of a sequence are sorted into groups of equal cardinality and rounded up to the
   largest of their group; configurations of the rounded lengths are chosen by a knapsack over the open counts; the
   actual lengths of a group then stand in for its rounded length; what is left, and all small lengths, go best-fit into
   the free room, longest first. Sequences with one history stay one entry of the plan, which therefore has a few
   thousand entries however many sequences it stands for.
3. Pieces are numbered inside their length, in buckets, and look their place up in the plan.

Defined results: null and empty texts are one piece, the closing id. Repeated rows and ids are packed each for itself.
Empty tables give an empty result. Extra columns are not read. Pieces that a document yields are numbered from 0.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import number_rows, table, written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Lengths above this share of a sequence are grouped; the rest is small.
SMALL_SHARE = 8
GROUPS = (512, 64, 0)
#: A configuration is used when its rounded lengths leave at most so much of a sequence free.
SLACK = 8
#: Words whose ids a Python worker keeps at a time; others are tokenized again.
CACHE_WORDS = 300_000
#: White space for str.split, but not for the vocabulary.
NOT_SPACE = re.compile("[\x1c-\x1f]")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row_id bigint, row_hash bigint, ids binary"


def _words(text: str) -> list[str]:
    """Parts between white space; both sides of a cut are tokenized alike."""
    return re.split(r"[ \t\n\r\x0b\x0c]+", text) if NOT_SPACE.search(text) else text.split()


#: Characters of the byte-level alphabet, fixed by the vocabulary: printable bytes stand for themselves, others follow 255.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
MARKS = "".join(c for c in string.punctuation if c != "'")


class _Words(dict):
    """Ids of words, made when they are first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.make(word)
        return ids


class WordTokenizer:
    """Ids of whole texts. The vocabulary drops white space, so a text's ids are those of its words in order.

    Words of letters, with or without closing marks, go straight to the merges; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.known, self.letters, self.marks = _Words(self._word), _Words(self._letters), _Words(self._whole)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, low: str) -> bytes:
        """Ids of one run of lower-case, composed letters."""
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(BYTE_ALPHABET)
        return array("I", [t.id for t in self.merges(low)]).tobytes()

    def _word(self, word: str) -> bytes:
        stem = word if word.isalpha() else word.rstrip(MARKS)
        low = stem.lower()
        if not low.isalpha() or not stem.isalpha() or not (stem.isascii() or ("Σ" not in stem and unicodedata.is_normalized("NFC", stem))):
            return self._whole(word)
        return self.letters[low] + (self.marks[word[len(stem) :]] if len(stem) < len(word) else b"")

    def ids(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text and the closing id."""
        end, get = array("I", [end_id]).tobytes(), self.known.__getitem__
        out = [b"".join(map(get, _words(t))) + end for t in texts]
        for kept in (self.known, self.letters, self.marks):
            if len(kept) > CACHE_WORDS:
                kept.clear()
        return out


def _parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A very long text in parts that end at white space, so that words stay whole."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in " \n\t\r\x0b\x0c")
        if cut <= at:
            cut = next((i for i in range(at + size, len(text)) if text[i] in " \n\t\r\x0b\x0c"), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ``ids`` (little-endian, if asked for) and the row's number and hash."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(tokenizer_path)
        width = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column("text").to_pylist()
                rows = zip(part.column("row_id").to_pylist(), part.column("row_hash").to_pylist(), strict=True)
                out = defaultdict(list)
                long = [t for t in texts if t is not None and len(t) > 1 << 20]
                ready = iter(tok.ids([t or "" for t in texts if t is None or len(t) <= 1 << 20], end_id))
                for doc_id, text, (row_id, h) in zip(part.column("doc_id").to_pylist(), texts, rows, strict=True):
                    if long and text is not None and len(text) > 1 << 20:
                        ids = b"".join(tok.ids([p], end_id)[0][:-4] for p in _parts(text)) + np.asarray([end_id], "<u4").tobytes()
                    else:
                        ids = next(ready)
                    for k, start in enumerate(range(0, len(ids), width)):
                        own = ids[start : start + width]
                        out["doc_id"].append(doc_id)
                        out["piece"].append(k)
                        out["start"].append(start // 4)
                        out["length"].append(len(own) // 4)
                        out["ids_crc32"].append(zlib.crc32(own))
                        out["row_id"].append(row_id)
                        out["row_hash"].append(h)
                        out["ids"].append(own if with_ids else None)
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_id", "row_hash", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)

    # repeated rows get hashes of their own; the pieces are written, so that a lost task changes none
    spread = F.shiftright(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), 33) + 2**30
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_id"), spread.alias("row_hash"))
    return own.mapInArrow(tokenized, PIECES)


class Plan:
    """Assigns the k-th piece of a length to a sequence and an offset, for all k at once.

    ``entries``: (length, first k, number of pieces, first sequence, pieces per sequence, offset of the first).
    Sequences are runs of neighbours with equal room, kept by their room.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first sequence, sequences)
        self.entries: list[tuple[int, int, int, int, int, int]] = []

    def place(self, length: int, first: int, sequences: int, each: int, n: int, offset: int) -> None:
        """n pieces of a length into a run of sequences, ``each`` into every one (the last may get fewer)."""
        self.entries.append((length, self.used[length], n, first, each, offset))
        self.used[length] += n
        self.left[length] -= n

    def leave(self, room: int, first: int, sequences: int) -> None:
        if sequences and room:
            self.open[room].append((first, sequences))

    def best_fit(self, length: int) -> None:
        """All open pieces of a length into the tightest rooms, then into new sequences."""
        rooms = iter(sorted(r for r in self.open if r >= length))
        while self.left[length]:
            room = next(rooms, None)
            if room is None:
                each = self.capacity // length
                fresh = -(-self.left[length] // each)
                self.open[self.capacity].append((self.sequences, fresh))
                self.sequences += fresh
                rooms = iter([self.capacity])
                continue
            runs = self.open.pop(room)
            while runs and self.left[length]:
                first, n = runs.pop()
                each = room // length
                full = min(n, self.left[length] // each)
                offset = self.capacity - room
                if full:
                    self.place(length, first, full, each, full * each, offset)
                    self.leave(room - full and room - each * length, first, full)
                rest = self.left[length]
                if full < n and rest:  # fewer than fill one more sequence
                    self.place(length, first + full, 1, rest, rest, offset)
                    self.leave(room - rest * length, first + full, 1)
                    full += 1
                if full < n:
                    runs.append((first + full, n - full))
            if runs:
                self.open[room].extend(runs)


def _groups(counts: dict[int, int], small: int, n_groups: int) -> list[list[int]]:
    """Large lengths, longest first, in runs of about equal cardinality."""
    large = sorted((x for x in counts if x > small and counts[x]), reverse=True)
    each = sum(counts[x] for x in large) / n_groups
    groups: list[list[int]] = []
    seen = 0
    for x in large:
        if not groups or seen >= each * len(groups):
            groups.append([])
        groups[-1].append(x)
        seen += counts[x]
    return groups


def _configuration(sizes: list[int], open_: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, within what is open: a bounded knapsack by bits."""
    reach = [1]
    for size, n in zip(sizes, open_, strict=True):
        now = reach[-1]
        for _ in range(min(n, capacity // size)):
            grown = now | (now << size) & ((1 << capacity + 1) - 1)
            if grown == now:
                break
            now = grown
        reach.append(now)
    fill, take = reach[-1].bit_length() - 1, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i] >> fill & 1:
            fill -= sizes[i]
            take[i] += 1
    return take


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences over some numbers of groups; with none, all lengths go best-fit."""
    return min((grouped_plan(counts, capacity, n) for n in GROUPS), key=lambda p: p.sequences)


def grouped_plan(counts: dict[int, int], capacity: int, n_groups: int) -> Plan:
    plan = Plan(counts, capacity)
    small = capacity // SMALL_SHARE
    groups = _groups(counts, small, n_groups) if n_groups else []
    rounded = [g[0] for g in groups]
    open_ = [sum(counts[x] for x in g) for g in groups]
    for largest, size in enumerate(rounded):
        while open_[largest]:
            # every configuration holds the largest open size, whose partners are the hardest to find
            rest = [n - (g == largest) for g, n in enumerate(open_)]
            take = _configuration(rounded, rest, capacity - size)
            take[largest] += 1
            if capacity - sum(t * r for t, r in zip(take, rounded, strict=True)) > SLACK:
                break
            times = min(o // t for o, t in zip(open_, take, strict=True) if t)
            first = plan.sequences
            plan.sequences += times
            runs = [(first, times, 0)]  # first sequence, sequences, tokens so far
            for g, t in enumerate(take):
                open_[g] -= t * times
                for _ in range(t):
                    grown = []
                    for start, n, filled in runs:
                        while n:
                            length = next(x for x in groups[g] if plan.left[x])
                            m = min(n, plan.left[length])
                            plan.place(length, start, m, 1, m, filled)
                            grown.append((start, m, filled + length))
                            start, n = start + m, n - m
                    runs = grown
            for start, n, filled in runs:
                plan.leave(capacity - filled, start, n)
    for length in sorted(counts, reverse=True):
        plan.best_fit(length)
    return plan


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(counts, capacity)
    schema = "length bigint, first bigint, n bigint, sequence bigint, each bigint, at bigint"
    entries = spark.createDataFrame(plan.entries, schema)
    ranked = number_rows(found, ["length"], F.col("row_hash"), ["doc_id", "piece", "ids_crc32"], "k", sum(counts.values()))
    runs = entries.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "each", "at"))).alias("runs"))
    placed = ranked.join(F.broadcast(runs), "length")  # at most ``capacity`` rows; their runs are a few thousand in all
    own = F.filter("runs", lambda r: (F.col("k") >= r["first"]) & (F.col("k") < r["first"] + r["n"]))
    placed = placed.withColumn("run", F.get(own, F.lit(0))).withColumn("_i", F.col("k") - F.col("run.first"))
    placed = placed.withColumn("sequence_id", F.col("run.sequence") + F.expr("_i div run.each"))
    placed = placed.withColumn("offset", F.col("run.at") + F.col("_i") % F.col("run.each") * F.col("length"))
    return placed.select(*found.columns, "sequence_id", "offset")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """All pieces with their ids and their place. Places are found without the ids, which are dealt once, to join them."""
    found = written(pieces(docs, tokenizer or tokenizer_path(), capacity, with_ids=with_ids))
    placed = pack(found.drop("ids"), capacity).drop("row_hash")
    if with_ids:
        placed = placed.join(found.select("row_id", "piece", "ids"), ["row_id", "piece"])
    return placed.drop("row_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
