"""Near-duplicate documents with HyperMinHash.

1. Every text becomes its set of five-word shingles, as 64-bit hashes. Equal sets are one node from here on.
2. The sketch has ``REGISTERS`` registers. A register keeps the smallest hash of its part of the hash range in 16 bits:
   the number of leading zeros and ten mantissa bits. A register without a shingle borrows from the filled register that
   comes first in an order of its own, so that two sketches agree in a register with about the Jaccard similarity
   whatever the sizes of the sets.
3. Bands of ``ROWS`` registers are the candidate keys. Members of a bucket are first compared with the smallest member
   only, each with the one it meets in most bands; buckets that hold several components after that are compared in
   blocks of bounded size. So a group of copies costs its size, not its square, and no partner is ever given up.
4. Candidates are estimated from the sketches, corrected for chance agreement of registers; what may reach the threshold
   is verified on the full sets, recomputed from the texts. A text is sent once for many partners. Texts are fetched by
   id and digest, so one without an id is found like any other.
5. Components of the verified links are found by star contractions.

A pair of similarity 0.75 misses all bands with probability (1 - 0.75**6)**48 = 0.00008; 0.8 with 0.0000005. The
estimate passes everything within six standard deviations of the threshold.

Defined results: texts without words, and null, have an empty set, are linked with nothing and kept. Rows repeated with
one id count as documents of their own; equal ones are linked as copies and share the id, so each is kept if the id is
the smallest. A null id is never the smallest of a group that has another. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import table, written
from cytomesh.llm.components import components

#: Fixed by the task.
SHINGLE = 5
PERCENT = 75

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations below the threshold that an estimate may lie.
SIGMAS = 6.0
#: Fixed by the published estimator: chance agreement of two registers is this over 2**mantissa for sets of equal size.
CHANCE = 0.169919487159739
#: Members of a bucket that one task compares with each other, and partners that one copy of a text serves.
BLOCK, PARTNERS = 512, 256
#: Narrow rows (two numbers) of which a checked table may be broadcast.
NARROW_ROWS = 1_000_000

_rng = np.random.default_rng(0xC0FFEE)
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64)
MULTIPLIERS = _rng.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
BORROW = _rng.permuted(np.tile(np.arange(REGISTERS, dtype=np.uint16), (REGISTERS, 1)), axis=1)
BASE = int(_rng.integers(2**62, 2**63)) * 2 + 1
_powers: list[np.ndarray] = []
PART = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PART + 4096)
        tables = []
        for b in (BASE % 2**64, pow(BASE, -1, 2**64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word in UTF-8 bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * up[: len(data)], dtype=np.uint64)])
    return starts, _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Per text the hashes of its words; short texts share one pass, very long ones are read in parts."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    group: list[int] = []
    raw: list[bytes] = []

    def flush() -> None:
        if not group:
            return
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        starts, hashes = _hash_words(np.frombuffer(b" ".join(raw), dtype=np.uint8))
        cut = np.searchsorted(starts, bounds)
        for k, i in enumerate(group):
            out[i] = hashes[cut[k] : cut[k + 1]]
        group.clear()
        raw.clear()

    size = 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").lower()  # A-Z only: these are bytes
        if len(data) <= PART:
            if size + len(data) > PART:
                flush()
                size = 0
            group.append(i)
            raw.append(data)
            size += len(data) + 1
            continue
        parts, at = [], 0
        while at < len(data):
            end = at + PART
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            parts.append(_hash_words(np.frombuffer(data[at:end], dtype=np.uint8))[1])
            at = end
        out[i] = np.concatenate(parts)
    flush()
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    sets = []
    for w in _word_hashes(texts):
        n = len(w) - SHINGLE + 1
        if n >= 1:
            s = sum(w[k : k + n] * MULTIPLIERS[k] for k in range(SHINGLE))
        elif len(w):
            s = (w * MULTIPLIERS[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))
        else:
            s = w
        sets.append(np.unique(_mix(s)))
    return sets


def sketch(own: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set: leading zeros and mantissa of the smallest hash per part of the range."""
    part = ((own >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    lowest = np.minimum.reduceat(_mix(own ^ np.uint64(0x5851F42D4C957F2D)), first)
    # a float64 holds the exponent (64 - leading zeros) above the mantissa
    packed = np.maximum(lowest, np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    regs = np.zeros(REGISTERS, np.uint16)
    filled = part[first]
    regs[filled] = (packed - np.uint64(1023 << MANTISSA)).astype(np.uint16)
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        regs[empty] = regs[filled[BORROW[np.ix_(empty, filled)].argmin(axis=1)]]
    return regs


def text_digest() -> Column:
    return F.unhex(F.md5("text"))


def id_order() -> Column:
    """Rows by their ids, null last, then by their texts."""
    return F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "mark")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (digest of the text), n_shingles, fp (digest of the whole set; null if empty), regs."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("mark"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "mark", "n_shingles", "fp", "regs"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("mark"), "text")
    return own.mapInArrow(signed, "doc_id bigint, mark binary, n_shingles bigint, fp binary, regs binary")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (rows of a and b), corrected for registers that agree by chance."""
    ratio = na / nb
    chance = CHANCE * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs can reach the threshold: by their sizes, and by the estimate less its error.

    Borrowed registers repeat others, so small sets count as samples of their own size.
    """
    j = PERCENT / 100
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    error = SIGMAS * np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.maximum(small, 1)))
    return (100 * small >= PERCENT * large) & (estimate(a, b, na, nb) >= j - error)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked."""
    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = may_link(*(_registers(batch.column(c)) for c in ("ra", "rb")), *(batch.column(c).to_numpy().astype(float) for c in ("na", "nb")))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(judged, "a bigint, b bigint")


def texts_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nid, fp, text of the nodes in ``ids``, by the id, which may be null, and the digest of one of their texts."""
    wanted = written(ids.join(nodes.select("nid", "rep", F.col("mark").alias("rep_mark"), "fp"), "nid"))
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("mark"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))
    found = known.join(F.broadcast(wanted) if wanted.count() <= NARROW_ROWS else wanted, same)
    return written(found.select("nid", "fp", "text").distinct())


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts of b are the fewer; each serves up to PARTNERS of a.

    The set's digest tells whether a text is the one that is meant.
    """
    pairs = written(pairs)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), nodes, docs)
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("chunks"))
    members = pairs.join(hubs, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    members = members.join(texts, F.col("a") == F.col("nid")).select("b", "chunk", F.lit(1).alias("kind"), "a", "fp", "text")
    heads = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    heads = heads.join(texts, F.col("b") == F.col("nid")).select("b", "chunk", F.lit(0).alias("kind"), F.col("b").alias("a"), "fp", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                cols = [part.column(c).to_pylist() for c in ("b", "chunk", "kind", "a", "fp", "text")]
                good: list[tuple[int, int]] = []
                for b, chunk, kind, a, fp, s in zip(*cols[:5], shingle_sets([t or "" for t in cols[5]]), strict=True):
                    if hashlib.blake2b(s, digest_size=16).digest() != fp:
                        continue
                    if kind == 0:
                        head, own = (b, chunk), s
                    elif head == (b, chunk):
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= PERCENT * (len(own) + len(s) - both):
                            good.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows_ = heads.unionByName(members).repartition("b", "chunk").sortWithinPartitions("b", "chunk", "kind")
    return written(rows_.mapInArrow(compared, "a bigint, b bigint"))


def band_members(nodes: DataFrame) -> DataFrame:
    """key, band, nid, hub (the bucket's smallest member), cnt of all buckets with more than one node."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    bands = nodes.select("nid", F.posexplode(keys).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("nid").alias("hub"), F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    return bands.join(shared, "key")


def candidates(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, own: np.ndarray, lo: int, hi: int, band: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """i, partners j and estimates: pairs of different components that may be linked, each in the first band it shares.

    Inside a block (lo = hi) every pair comes once, between two blocks from the first to the second.
    """
    for i in range(len(regs)):
        if lo != hi and own[i] != lo:
            continue
        js = np.flatnonzero((comp != comp[i]) & ((own == hi) if lo != hi else (np.arange(len(regs)) > i)))
        if len(js):
            same = regs[js] == regs[i]
            js = js[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(js):
            js = js[may_link(regs[i : i + 1], regs[js], np.full(len(js), float(n[i])), n[js].astype(float))]
        if len(js):
            yield i, js, (regs[js] == regs[i]).mean(axis=1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first three columns."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:3] != group[0][:3]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def block_links(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between different components of one bucket, enough of them to join all that are linked.

    ``members``: key, band, nid, comp, cnt. A bucket is cut into blocks; a task sees two blocks at a time, first the
    sketches alone, then the texts of those that have a candidate partner there. It verifies its candidates, likeliest
    first, until they are joined already, so it hands on less than a row a member.
    """
    blocks = F.ceil(F.col("cnt") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "band", "nid", "comp", "own", other).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    rows = rows.join(nodes.select("nid", "n_shingles", "regs"), "nid").select("key", "lo", "hi", "own", "band", "nid", "comp", "n_shingles", "regs")

    def of_group(group: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        own, comp, n = (np.array([r[k] for r in group]) for k in (3, 6, 7))
        regs = np.frombuffer(b"".join(r[8] for r in group), np.uint16).reshape(-1, REGISTERS)
        return candidates(regs, n, comp, own, group[0][1], group[0][2], group[0][4])

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            found = [np.append(js, i) for i, js, _ in of_group(group)]
            if found:
                hit = [group[k] for k in np.unique(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in hit], t) for k, t in zip(range(9), kinds, strict=True)], names)

    names = ["key", "lo", "hi", "own", "band", "nid", "comp", "n_shingles", "regs"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    fields = "key bigint, lo int, hi int, own int, band int, nid bigint, comp bigint, n_shingles bigint, regs binary"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            # the set's digest tells whether a text is the one that is meant
            sets = shingle_sets([r[10] or "" for r in group])
            good = [k for k, r in enumerate(group) if hashlib.blake2b(sets[k], digest_size=16).digest() == r[9]]
            group, sets = [group[k] for k in good], [sets[k] for k in good]
            pairs = [(-e, i, int(j)) for i, js, es in of_group(group) for j, e in zip(js, es.tolist(), strict=True)]
            root = {r[6]: r[6] for r in group}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = []
            for _, i, j in sorted(pairs):
                x, y = find(group[i][6]), find(group[j][6])
                if x != y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                        root[max(x, y)] = min(x, y)
                        links.append((group[i][5], group[j][5]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    block = ("key", "lo", "hi")
    suspects = written(rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(suspected, fields))
    texts = texts_of(suspects.select("nid").distinct(), nodes, docs)
    dealt = suspects.join(texts, "nid").select(*names, "fp", "text").repartition(*block).sortWithinPartitions(*block)
    return written(dealt.mapInArrow(joined, "a bigint, b bigint"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, root (of the component; null for empty sets) and component_id of every row."""
    signed = written(signatures(docs))
    least = F.min(id_order()).alias("least")  # of a set without ids too: a null id, and the digest of a text
    nodes = signed.where("fp IS NOT NULL").groupBy("fp").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    nodes = nodes.select("fp", F.col("least.doc_id").alias("rep"), "least.mark", "n_shingles", "regs")
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()))
    members = written(band_members(nodes))
    # every node with the hub it meets in most bands
    met = members.where("nid <> hub").groupBy("nid", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("nid").agg(F.max(F.struct("n", (-F.col("hub")).alias("h"))).alias("m"))
    stars = verified(estimated(best.select(F.col("nid").alias("a"), (-F.col("m.h")).alias("b")), nodes), nodes, docs)
    first = components(stars.select(F.col("a").alias("v"), F.col("b").alias("u")))
    # buckets that still hold several components
    placed = members.join(first.withColumnRenamed("v", "nid"), "nid", "left").select("key", "band", "nid", F.coalesce("root", "nid").alias("comp"), "cnt")
    placed = written(placed)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    links = stars.unionByName(block_links(placed.join(mixed, "key"), nodes, docs))
    found = components(links.select(F.col("a").alias("v"), F.col("b").alias("u")))
    roots = nodes.select("nid", "fp", "rep").join(found.withColumnRenamed("v", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = written(roots.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))
    out = signed.drop("regs").join(by_set, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "mark", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped(docs).select("doc_id", "n_shingles", "component_id", kept)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of the documents that stay, one of every group, the first by id and text; of equal rows with one id, one.

    Texts without words are in no group, so they stay.
    """
    rows = grouped(docs.select("doc_id", "text")).groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows)
    first = F.min(F.struct(id_order().alias("o"), "n")).alias("m")
    groups = rows.where("root IS NOT NULL").groupBy("root").agg(first).select("m.o.doc_id", "m.o.mark", "m.n")
    alone = rows.where("root IS NULL").select("doc_id", "mark", "n")
    keys = written(groups.unionByName(alone).select(F.col("doc_id").alias("_kept"), F.col("mark").alias("_mark"), (F.col("n") > 1).alias("_more")))

    def of(part: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("_kept")) & text_digest().eqNullSafe(F.col("_mark"))
        return docs.join(F.broadcast(part) if part.count() <= NARROW_ROWS else part, same, "left_semi")

    # texts are dealt only where equal rows share an id
    more = keys.where("_more")
    if more.isEmpty():
        return of(keys)
    return of(keys.where("NOT _more")).unionByName(of(more).dropDuplicates(["doc_id", "text"]))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
