"""A positional inverted index of training texts, searched for the phrases of benchmark items.

1. Tasks invert their texts into segments of a bounded number of words: per term one row with the ascending positions of
   the term in the segment, as gaps in variable-length bytes. Texts lie one after another in a segment with a gap between
   them; one row without a term tells where. The table is written once and serves any number of searches.
2. A search takes the phrases in blocks of bounded size. The index rows of a block's terms meet by segment. A phrase
   starts from the posting list of its rarest term over all texts, shifted by the term's place in the phrase, and is
   intersected with the shifted lists of its other terms, rarer ones first, all phrases of a segment at once.
3. With ``slop`` 0 these are the exact occurrences. With a larger one every term may lie up to that many words away from
   its place, in the same text, which holds all places: a proximity match.

Words: runs of letters and digits of ASCII and of all other characters, A-Z in lower case.

Defined results: null and empty texts have no words; they are rows of the result without hits. Repeated rows and ids are
documents of their own. An item without words has no phrase. A null item_id marks words, but is no item that is counted
or listed; items with one id are one. Very long texts are one segment. Empty tables give empty results, an empty
benchmark gives documents without hits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import delete, table, written

#: Words of a phrase; shorter items are one phrase.
PHRASE = 10
#: Words of a segment, unless one text alone is longer.
SEGMENT_WORDS = 1 << 20
#: Words of all phrase pieces that one search carries; more are searched block by block. Items are cut into pieces.
BLOCK_WORDS, PIECE_WORDS = 1 << 18, 1024
#: Shifted postings that are intersected together.
AT_ONCE = 1 << 20
#: Free positions before the first text and between texts.
MARGIN = 64
ROWS_AT_ONCE = 500

#: Fixed by the task: bytes between words become spaces, A-Z lower case.
LOWERED = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SEGMENT = "segment bigint, term binary, n bigint, postings binary"
MATCHES = "segment bigint, slot int, item_id string, item_start int, start bigint, length int"
COVERED = "segment bigint, slot int, spans array<struct<a: bigint, b: bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()


# --------------------------------------------------------------------------- lists of ascending numbers as bytes


def packed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of several ascending lists, one after another, and where each ends. Gaps of 7 bits a byte, lowest first."""
    first = np.zeros(len(values), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0].astype(np.int64)] = True
    gaps = np.where(first, values, values - np.concatenate([[0], values[:-1]])).astype(np.uint64)
    width = np.ones(len(gaps), np.int64)
    for bits in (7, 14, 21, 28):
        width += gaps >= np.uint64(1 << bits)
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(5):
        has = width > k
        out[at[:-1][has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)) | ((width[has] > k + 1) * np.uint64(128))
    return out, at[np.cumsum(counts)]


def unpacked(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The lists that ``packed`` wrote, one after another."""
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    width = last - begin + 1
    gaps = np.zeros(len(last), np.int64)
    for k in range(5):
        has = width > k
        gaps[has] |= (data[begin[has] + k] & 127).astype(np.int64) << (7 * k)
    sums = np.cumsum(gaps)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    full = counts > 0
    base = np.where(starts[full] > 0, sums[np.maximum(starts[full], 1) - 1], 0)
    return sums - np.repeat(base, counts[full])


# --------------------------------------------------------------------------- the index


@dataclass
class Index:
    """``terms``: see SEGMENT; a row without a term holds the ends of the segment's texts. ``docs``: segment, slot, doc_id, n_words."""

    terms: DataFrame
    docs: DataFrame


def build(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> Index:
    """Index the rows (doc_id, text). A lost task is repeated alone; nothing is shuffled."""
    from pyspark import TaskContext

    kinds = f"kind int, {SEGMENT}, slot int, doc_id bigint, n_words bigint"
    names = [c.split()[0] for c in kinds.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(made, names)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal segment, held
            lengths = np.array(sizes, np.int64)
            starts = MARGIN + np.concatenate([[0], np.cumsum(lengths + MARGIN)[:-1]]).astype(np.int64)
            which = np.concatenate(ids) if ids else np.empty(0, np.int32)
            order = np.argsort(which, kind="stable")
            position = np.arange(len(which)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths)
            counts = np.bincount(which, minlength=len(known)).astype(np.int64)
            data, ends = packed(position[order], counts)
            names_of = list(known)
            for a in range(0, len(names_of), 50_000):
                b = min(a + 50_000, len(names_of))
                lo = int(ends[a - 1]) if a else 0
                offsets = np.concatenate([[lo], ends[a:b]]) - lo
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[lo : ends[b - 1]].tobytes())])
                yield rows(kind=[1] * (b - a), segment=[segment] * (b - a), term=names_of[a:b], n=counts[a:b], postings=blobs)
            place, _ = packed(starts + lengths, np.array([len(sizes)]))
            yield rows(kind=[1], segment=[segment], n=[len(sizes)], postings=[place.tobytes()])
            yield rows(kind=[0] * len(sizes), segment=[segment] * len(sizes), slot=list(range(len(sizes))), doc_id=doc_ids, n_words=sizes)
            for x in (known, ids, doc_ids, sizes):
                x.clear()
            segment, held = segment + 1, 0

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = words_of(text)
                    ids.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
                    doc_ids.append(doc_id)
                    sizes.append(len(words))
                    held += len(words) + 8
                    if held >= segment_words:
                        yield from flush()
        if sizes:
            yield from flush()

    got = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(invert, kinds), by=["kind"])
    return Index(got.where("kind = 1").select("segment", "term", "n", "postings"), got.where("kind = 0").select("segment", "slot", "doc_id", "n_words"))


def pieces(items: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """item_id, item_start, words: items cut so that every phrase lies in one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for at in range(0, max(len(words) - phrase, 0) + 1, PIECE_WORDS):
                    if words:
                        out.append((item, at, words[at : at + PIECE_WORDS + phrase - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.binary()))],
                ["item_id", "item_start", "words"],
            )

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, item_start int, words array<binary>")


# --------------------------------------------------------------------------- the search


class Phrases:
    """The phrases of one block: per phrase the ids of its terms and their places, rarest first."""

    def __init__(self, block: list[tuple[str | None, int, list[bytes]]], counts: dict[bytes, int], phrase: int):
        self.terms = {w: i for i, w in enumerate(sorted({w for _, _, words in block for w in words}))}
        often = np.array([counts.get(w, 0) for w in self.terms] or [0], np.int64)
        named = sorted({i for i, _, _ in block}, key=lambda x: (x is None, x or ""))
        number = {i: k for k, i in enumerate(named)}
        self.items = named
        windows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, at, words in block:
            ids = [self.terms[w] for w in words]
            for s in range(max(len(ids) - phrase, 0) + 1):
                windows.setdefault(tuple(ids[s : s + phrase]), []).append((number[item], at + s))
        self.length = np.array([len(w) for w in windows], np.int64)
        self.ids = np.zeros((len(windows), phrase), np.int64)
        self.places = np.zeros((len(windows), phrase), np.int64)
        for k, w in enumerate(windows):
            rare = sorted(range(len(w)), key=lambda j: (often[w[j]], j))
            self.ids[k, : len(w)] = [w[j] for j in rare]
            self.places[k, : len(w)] = rare
        #: where the phrase stands: (item, start) pairs, one after another
        self.uses = np.array([u for us in windows.values() for u in us], np.int64).reshape(-1, 2)
        self.use_ends = np.cumsum([len(u) for u in windows.values()])

    def occurrences(self, terms: list[bytes], counts: np.ndarray, postings: np.ndarray, text_ends: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) arrays for one segment: its terms with the lengths of their lists, and the lists."""
        local = np.full(len(self.terms) + 1, -1, np.int64)
        local[[self.terms[t] for t in terms]] = np.arange(len(terms))
        size = np.concatenate([counts, [0]])
        begin = np.concatenate([[0], np.cumsum(counts)])
        keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 40) | postings
        used = np.arange(self.ids.shape[1])[None] < self.length[:, None]
        here = np.flatnonzero(((local[self.ids] >= 0) | ~used).all(axis=1))
        lists = local[self.ids[here, 0]]
        upto = np.cumsum(size[lists])
        done = 0
        while done < len(here):
            before = upto[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(upto, before + AT_ONCE, "right")))
            for a in range(0, int(upto[end - 1] - before), AT_ONCE):  # a single list may be longer
                total = int(min(upto[end - 1] - before - a, AT_ONCE))
                number = before + a + np.arange(total)
                row = np.searchsorted(upto[done:end], number, "right") + done
                nth = number - (upto[row] - size[lists[row]])
                phrase = here[row]
                start = postings[begin[lists[row]] + nth] - self.places[phrase, 0]
                for j in range(1, self.ids.shape[1]):
                    long = self.length[phrase] > j
                    want = (local[self.ids[phrase, j]] << 40) + start + self.places[phrase, j]
                    found = np.searchsorted(keys, want - slop)
                    hit = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] <= want + slop)
                    phrase, start = phrase[hit | ~long], start[hit | ~long]
                # the whole place lies in one text
                text = np.searchsorted(text_ends, start, "right")
                same = (text < len(text_ends)) & (start + self.length[phrase] <= text_ends[np.minimum(text, len(text_ends) - 1)])
                first = np.where(text > 0, text_ends[np.maximum(text, 1) - 1] + MARGIN, MARGIN)
                same &= start >= first
                yield phrase[same], start[same]
            done = end


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Index rows sorted by segment, terms before the row of text ends, as one tuple per segment."""
    key, terms, counts, blobs = None, [], [], []
    for batch in batches:
        for segment, term, n, data in zip(*(batch.column(c).to_pylist() for c in ("segment", "term", "n", "postings")), strict=True):
            if segment != key:
                key, terms, counts, blobs = segment, [], [], []
            if term is not None:
                terms.append(term)
                counts.append(n)
                blobs.append(data)
                continue
            lists = np.array(counts, np.int64)
            ends = unpacked(np.frombuffer(data, np.uint8), np.array([n]))
            if terms:
                yield segment, terms, lists, unpacked(np.frombuffer(b"".join(blobs), np.uint8), lists), ends


def _blocks(index: Index, items: DataFrame, phrase: int) -> Iterator[Phrases]:
    """The phrases, block by block; a block is bounded by BLOCK_WORDS."""
    cut = written(pieces(items, phrase))
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-2 * total // BLOCK_WORDS)
    for b in range(blocks):
        # a block is expected to be half full; one that chance fills beyond the bound is handled in parts
        part = cut.where(F.pmod(F.xxhash64("item_id", "item_start"), F.lit(blocks)) == b)
        rows: list[tuple[str | None, int, list[bytes]]] = []
        held = 0
        for r in part.toLocalIterator():
            rows.append((r["item_id"], r["item_start"], [bytes(w) for w in r["words"]]))
            held += len(rows[-1][2])
            if held >= BLOCK_WORDS:
                yield _phrases(index, rows, phrase)
                rows, held = [], 0
        if rows:
            yield _phrases(index, rows, phrase)
    delete(cut)


def _phrases(index: Index, rows: list, phrase: int) -> Phrases:
    spark = index.terms.sparkSession
    terms = spark.createDataFrame([(bytearray(w),) for w in sorted({w for _, _, words in rows for w in words})], "term binary")
    counted = index.terms.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    return Phrases(rows, {bytes(r["term"]): r["n"] for r in counted.collect()}, phrase)


def _searched(index: Index, phrases: Phrases, kernel, schema: str) -> DataFrame:
    """Run ``kernel`` over the segments that hold any of the block's terms."""
    spark = index.terms.sparkSession
    terms = spark.createDataFrame([(bytearray(w),) for w in phrases.terms], "term binary")
    rows = index.terms.join(F.broadcast(terms), "term", "left_semi").unionByName(index.terms.where("term IS NULL"))
    return rows.repartition("segment").sortWithinPartitions("segment", F.asc_nulls_last("term")).mapInArrow(kernel, schema)


def find_matches(index: Index, items: DataFrame, slop: int = 0, phrase: int = PHRASE) -> DataFrame:
    """doc_id, segment, slot, item_id, item_start, start, length: where words of an item stand in a document.

    With ``slop`` 0 phrases that go on word by word are one row of ``length`` words. Otherwise every row is one phrase and
    ``start`` the place that its rarest term gives it.
    """
    if not 0 <= slop < MARGIN:
        raise ValueError(f"slop must be from 0 to {MARGIN - 1}")
    found = None
    for phrases in _blocks(index, items, phrase):
        spread = index.terms.sparkSession.sparkContext.broadcast(phrases)

        def kernel(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            known = spread.value
            for segment, terms, counts, postings, ends in _segments(batches):
                for which, start in known.occurrences(terms, counts, postings, ends, slop):
                    n = known.use_ends[which] - np.where(which > 0, known.use_ends[np.maximum(which, 1) - 1], 0)
                    row = np.repeat(np.arange(len(which)), n)
                    use = known.uses[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(known.use_ends[which] - n, n)]
                    at, length = start[row], known.length[which][row]
                    if slop == 0 and len(row):
                        diagonal = at - use[:, 1]
                        order = np.lexsort((at, diagonal, use[:, 0]))
                        item, diagonal, at, begin, length = use[order, 0], diagonal[order], at[order], use[order, 1], length[order]
                        same = (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (at[1:] <= at[:-1] + 1)
                        head = np.concatenate([[True], ~same])
                        tail = np.concatenate([~same, [True]])
                        length = at[tail] + length[tail] - at[head]
                        item, begin, at = item[head], begin[head], at[head]
                    else:
                        item, begin = use[:, 0], use[:, 1]
                    slot = np.searchsorted(ends, at, "right")
                    first = np.where(slot > 0, ends[np.maximum(slot, 1) - 1] + MARGIN, MARGIN)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), segment)), pa.array(slot, pa.int32()), pa.array([known.items[i] for i in item], pa.string()), pa.array(begin, pa.int32()), pa.array(at - first), pa.array(length, pa.int32())],
                        [c.split()[0] for c in MATCHES.split(", ")],
                    )

        part = written(_searched(index, phrases, kernel, MATCHES))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return index.docs.where("false").selectExpr("doc_id", "segment", "slot", "'' AS item_id", "0 AS item_start", "0L AS start", "0 AS length")
    return found.join(index.docs.select("segment", "slot", "doc_id"), ["segment", "slot"]).select("doc_id", *found.columns)


def contamination(index: Index, items: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_hit (words inside phrases of items), items (their distinct ids, sorted as strings), per document."""
    found = None
    for phrases in _blocks(index, items, phrase):
        spread = index.terms.sparkSession.sparkContext.broadcast(phrases)

        def kernel(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            known = spread.value
            for segment, terms, counts, postings, ends in _segments(batches):
                hit = np.zeros(int(ends[-1]) + 2, np.int32) if len(ends) else np.zeros(2, np.int32)
                held: list[np.ndarray] = []
                for which, start in known.occurrences(terms, counts, postings, ends, 0):
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + known.length[which], -1)
                    slot = np.searchsorted(ends, start, "right")
                    held.append(np.unique((slot << 32) | which))
                if not held or not any(map(len, held)):
                    continue
                covered = (np.cumsum(hit) > 0).astype(np.int8)
                turn = np.diff(covered, prepend=np.int8(0))
                a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                own = np.searchsorted(ends, a, "right")
                pairs = np.unique(np.concatenate(held))
                slots = np.unique(own)
                bounds = np.searchsorted(own, slots, "left").tolist() + [len(own)]
                cuts = np.searchsorted(pairs >> 32, slots, "left").tolist() + [len(pairs)]
                spans, named = [], []
                for k in range(len(slots)):
                    spans.append([{"a": int(x), "b": int(y)} for x, y in zip(a[bounds[k] : bounds[k + 1]], b[bounds[k] : bounds[k + 1]], strict=True)])
                    which = pairs[cuts[k] : cuts[k + 1]] & 0xFFFFFFFF
                    uses = {int(u) for w in which for u in known.uses[(known.use_ends[w - 1] if w else 0) : known.use_ends[w], 0]}
                    named.append([known.items[u] for u in uses if known.items[u] is not None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * len(slots), pa.int64()), pa.array(slots, pa.int32()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(named, pa.list_(pa.string()))],
                    ["segment", "slot", "spans", "items"],
                )

        part = written(_searched(index, phrases, kernel, COVERED))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return index.docs.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    per_doc = found.groupBy("segment", "slot").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n"))
    grown = lambda acc, s: F.struct(
        F.greatest(acc["b"], s["b"]).alias("b"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["b"], s["a"]))).alias("n")
    )
    hits = per_doc.select("segment", "slot", F.aggregate("spans", start, grown)["n"].alias("n_hit"), "items")
    both = index.docs.join(hits, ["segment", "slot"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


PHRASE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), {PHRASE}) AS n, unnest(range(1, greatest(len(w) - {PHRASE}, 0) + 2)) AS s FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM starts),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM phrases)),
hits AS (SELECT r, p, n, item_id FROM (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM places) JOIN phrases USING (n, phrase)),
covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS word FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
