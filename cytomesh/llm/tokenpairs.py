"""How two tokenizers cut the same texts, aligned once per distinct text.

1. Rows are shuffled by their full text, equal rows of a task counted first, so a text is one row with its multiplicity.
2. A task tokenizes a text with both tokenizers and cuts it wherever tokens of both end at one byte; the two tokens that
   end there are linked. Both cut a text independently at every space that follows something else (checked once against
   the vocabularies), so stretches up to such spaces are aligned once per task and looked up afterwards.
3. Links of an id pair are summed over all texts, weighted by multiplicity. The most frequent pairs, a fixed number, are
   handed to all tasks; links of all other pairs meet their counts by a shuffle.
4. The measures of a text go to its rows by its digest; texts that make up a large share of the rows, which can only be
   few, by a broadcast.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens and no
links. Repeated rows and ids count, and are returned, each for itself. Very long texts are read whole. Empty tables give
empty results. Extra columns are not read. Ids of the second tokenizer must be below ``PIECES``.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import table, written

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is a * PIECES + b.
PIECES = 1 << 15
#: Pairs handed to all tasks; stretches of text that a worker remembers, and as many older ones.
HEAD_PAIRS, REMEMBERED = 1 << 18, 120_000
#: A text with more than this share of all rows is a large one; there are fewer than the inverse.
LARGE_SHARE = 1 / 1000
ROWS_AT_ONCE = 500
#: Fixed by the first tokenizer: how it splits a text before merging.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point, every library agrees on what a letter is.
LATIN_END = "\u0370"
#: A place where both tokenizers begin anew: a space after something that no tokenizer takes for white space.
BREAK = re.compile(r"(?<=\S)(?= )")

ALIGNED = "digest string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_agree(path: str) -> bool:
    """Whether merging any two neighbours whose bytes are a token, lowest id first, follows the listed merges alone.

    It does if every token is put together last by its own merge: what happens inside a token does not depend on its
    surroundings, so no other merge can ever come up. Checked once per run, on the driver.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and spec.get("normalizer") is None and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    letters = _byte_letters()
    raw = lambda t: bytes(letters[c] for c in t)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    rank = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    ids = [rank.get(a + b) for a, b in merges]
    if None in ids or any(x >= y for x, y in zip(ids, ids[1:])) or len(merges) + 256 != len(rank) or len(set(rank.values())) != len(rank):
        return False
    for (a, b), top in zip(merges, ids, strict=True):
        parts = [bytes([c]) for c in a + b]
        while len(parts) > 2:
            best = min((rank.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
            if best[0] >= top:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if parts != [a, b]:
            return False
    return True


class Aligner:
    """Both tokenizers, the bytes of their ids, and the stretches aligned so far."""

    def __init__(self, path_a: str, path_b: str, ranked: bool | None = None):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.digits = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        ranked = ranks_agree(path_a) if ranked is None else ranked
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        ranks = {b: i for i, b in enumerate(self.bytes_a) if i not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        self.length_a, self.length_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        if len(self.bytes_b) > PIECES:
            raise ValueError(f"ids of the second tokenizer must be below {PIECES}")
        # a piece that holds a space after something else would cross a break
        crossing = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.bytes_b)))
        self.whole = crossing  # then every text is one stretch
        self.space = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        self.older: dict[str, tuple[int, int, bytes, bytes] | None] = {}

    def stretches(self, text: str) -> list[str]:
        """The text cut at its breaks; every stretch is given without the space it starts with."""
        if self.whole:
            return [text]
        parts = text.split(" ")
        if all(p and not p[-1].isspace() for p in parts):
            return parts
        return [s[1:] for s in BREAK.split(" " + text)]

    def learn(self, stretches: set[str]) -> None:
        """Make ``known`` hold all of these, from the older ones or anew."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = []
        for s in stretches:
            if s not in known:
                if s in older:
                    known[s] = older[s]
                else:
                    fresh.append(s)
        if not fresh:
            return
        if not self._learn_together(fresh):
            for s in fresh:
                ids = self.a.encode(" " + s, add_special_tokens=False).ids
                known[s] = self.align((" " + s).encode("utf-8", "surrogatepass"), ids, self.b.encode(s) or [self.space])

    def _ids_a(self, stretches: list[str]) -> list[list[int]]:
        """Ids of the first tokenizer, all together where the ranks give the same."""
        joined = [self.ranks is not None and s != "" and max(s) < LATIN_END and not s[-1].isspace() for s in stretches]
        out: list[list[int]] = [[]] * len(stretches)
        rest = [k for k, j in enumerate(joined) if not j]
        for k, e in zip(rest, self.a.encode_batch_fast([" " + stretches[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        own = [k for k, j in enumerate(joined) if j]
        if own:
            # each is cut off at its first space whatever stands before it
            ids = self.ranks.encode_ordinary(" " + " ".join([stretches[k] for k in own]))
            ends = np.cumsum(self.length_a[ids])
            sizes = np.cumsum([len(stretches[k].encode("utf-8", "surrogatepass")) + 1 for k in own])
            left = 0
            for k, right in zip(own, (np.searchsorted(ends, sizes) + 1).tolist(), strict=True):
                out[k] = ids[left:right]
                left = right
        return out

    def _learn_together(self, stretches: list[str]) -> bool:
        """Align stretches as one sequence; False if a tokenizer does not give them back."""
        data = [(" " + s).encode("utf-8", "surrogatepass") for s in stretches]
        per_a = self._ids_a(stretches)
        per_b = [ids or [self.space] for ids in self.b.encode(stretches, num_threads=1)]
        list_a, list_b = list(chain.from_iterable(per_a)), list(chain.from_iterable(per_b))
        bytes_a, bytes_b, whole = self.bytes_a, self.bytes_b, b"".join(data)
        if b"".join([bytes_a[i] for i in list_a]) != whole or b"".join([bytes_b[i] for i in list_b]) != whole:
            return False
        ids_a, ids_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        both, last_a, last_b = np.intersect1d(np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b]), assume_unique=True, return_indices=True)
        ends_a, ends_b = ids_a[last_a], ids_b[last_b]
        pairs = (ends_a * PIECES + ends_b).astype(np.int32).tobytes()
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        digits = self.digits
        groups = [digits[x] + "|" + digits[y] for x, y in zip(ends_a.tolist(), ends_b.tolist(), strict=True)]
        many = np.flatnonzero((n_a > 1) | (n_b > 1))
        spans = (x[many].tolist() for x in (last_a - n_a + 1, last_a + 1, last_b - n_b + 1, last_b + 1))
        for g, i, j, k, m in zip(many.tolist(), *spans, strict=True):
            groups[g] = ",".join([digits[x] for x in list_a[i:j]]) + "|" + ",".join([digits[x] for x in list_b[k:m]])
        upto = np.searchsorted(both, np.cumsum(list(map(len, data)))) + 1  # every stretch ends with a group
        left = 0
        for s, a, b, right in zip(stretches, per_a, per_b, upto.tolist(), strict=True):
            self.known[s] = (len(a), len(b), ";".join(groups[left:right]).encode(), pairs[4 * left : 4 * right])
            left = right
        return True

    def align(self, data: bytes, ids_a: list[int], ids_b: list[int]) -> tuple[int, int, bytes, bytes] | None:
        """Numbers of tokens, groups as text, and links as pairs; None where a tokenizer does not give ``data`` back."""
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        if b"".join([bytes_b[j] for j in ids_b]) != data or b"".join([bytes_a[i] for i in ids_a]) != data:
            return None
        groups, pairs = [], []
        ahead = 0  # bytes that the tokens of the first reach beyond those of the second
        left_i = left_j = j = 0
        for i, x in enumerate(ids_a, 1):
            ahead += len(bytes_a[x])
            while ahead > 0:
                ahead -= len(bytes_b[ids_b[j]])
                j += 1
            if not ahead:
                y = ids_b[j - 1]
                if i - left_i == 1 and j - left_j == 1:
                    groups.append(f"{x}|{y}")
                else:
                    groups.append(f"{','.join(map(str, ids_a[left_i:i]))}|{','.join(map(str, ids_b[left_j:j]))}")
                pairs.append(x * PIECES + y)
                left_i, left_j = i, j
        return len(ids_a), len(ids_b), ";".join(groups).encode(), array("i", pairs).tobytes()

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, str, bytes] | None]:
        """Per text the numbers of tokens, the digest of its groups and its links; None without tokens."""
        cut = [self.stretches(t) if t else [] for t in texts]
        self.learn({s for c in cut for s in c})
        out: list[tuple[int, int, str, bytes] | None] = []
        for c in cut:
            found = [self.known[s] for s in c]
            if not found or None in found:
                out.append(None)
                continue
            n_a, n_b, groups, pairs = zip(*found, strict=True)
            out.append((sum(n_a), sum(n_b), hashlib.sha256(b";".join(groups)).hexdigest(), b"".join(pairs)))
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str, ranked: bool) -> Aligner:
    """One per Python worker, which serves many tasks."""
    return Aligner(path_a, path_b, ranked)


# --------------------------------------------------------------------------- on tables


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text, copies: every text once."""
    return docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ALIGNED rows of (text, copies); pairs are 4-byte numbers, one per link."""

    ranked = ranks_agree(path_a)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = aligner(path_a, path_b, ranked)
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                digests, copies, own = (c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)
                rows = [(d, c, n_a, n_b, len(p) // 4, g, p) for d, c, (n_a, n_b, g, p) in zip(digests, copies, [x or (0, 0, "", b"") for x in made.texts(own)], strict=True)]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in ALIGNED.split(", ")])

    return texts.select(F.sha2("text", 256).alias("digest"), "copies", "text").mapInArrow(align, ALIGNED)


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and the row of each."""
    blobs = batch.column("pairs").to_pylist()
    flat = np.frombuffer(b"".join(blobs), np.int32).astype(np.int64)
    return flat, np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold a pair over all texts with their copies, and whether no pair of its second id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.empty(0, np.int64), np.empty(0, np.int64)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])

        for batch in batches:
            flat, row = _pairs_of(batch)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            both = np.concatenate([pairs, flat])
            pairs, where = np.unique(both, return_inverse=True)
            added = np.concatenate([sums, copies[row]])
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, where, added)
            if len(pairs) > 4 * HEAD_PAIRS:
                yield block()
                pairs, sums = pairs[:0], sums[:0]
        yield block()

    counted = rows.select("copies", "pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted)
    most = counted.groupBy(F.pmod("pair", F.lit(PIECES)).alias("b")).agg(F.max("n").alias("most"))  # one row per piece of the vocabulary
    return written(
        counted.withColumn("b", F.pmod("pair", F.lit(PIECES))).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    )


def link_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """digest, n_best, count_sum per text. Pairs outside the most frequent ones are joined with their counts by a shuffle."""
    head = counts.orderBy(F.col("n").desc(), "pair").limit(HEAD_PAIRS).toArrow()  # bounded
    order = np.argsort(head.column("pair").to_numpy())
    handed = rows.sparkSession.sparkContext.broadcast(tuple(head.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = handed.value
        for batch in batches:
            digests = batch.column("digest")
            flat, row = _pairs_of(batch)
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            found = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[found], n[at[found]])
            np.add.at(bests, row[found], best[at[found]].astype(np.int64))
            others, times = np.unique((row[~found] << 32) | flat[~found], return_counts=True)
            texts = np.concatenate([np.arange(batch.num_rows), others >> 32])
            none = np.zeros(len(others), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    digests.take(pa.array(texts)),
                    pa.array(np.concatenate([np.full(batch.num_rows, -1), others & 0xFFFFFFFF])),
                    pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), times])),
                    pa.array(np.concatenate([bests, none])),
                    pa.array(np.concatenate([sums, none])),
                ],
                ["digest", "pair", "times", "n_best", "count_sum"],
            )

    parts = written(rows.select("digest", "pairs").mapInArrow(split, "digest string, pair bigint, times bigint, n_best bigint, count_sum bigint"))
    tail = parts.where("pair >= 0").join(counts, "pair").select(
        "digest", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    both = parts.where("pair < 0").select("digest", "n_best", "count_sum").unionByName(tail)
    return both.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row (doc_id, text)."""
    own = tokenizer_paths()
    rows = written(aligned(distinct_texts(docs), path_a or own[0], path_b or own[1]))
    sums = link_sums(rows, pair_counts(rows))
    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    whole = rows.withColumn("n_links", F.col("n_groups")).join(sums, "digest").select("digest", "copies", *measures)
    whole = written(whole)
    least = F.lit(max(docs.count() * LARGE_SHARE, 1.0))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("digest"))
    # fewer than 1 / LARGE_SHARE texts are large; their rows find them without a shuffle
    large = F.broadcast(whole.where(F.col("copies") > least))
    usual = ids.join(large.select("digest"), "digest", "left_anti").join(whole.where(F.col("copies") <= least), "digest", "left")
    both = ids.join(large, "digest").select("doc_id", *measures).unionByName(usual.select("doc_id", *measures))
    filled = {m: F.coalesce(m, F.lit("") if m == "groups_sha256" else F.lit(0).cast("bigint")).alias(m) for m in measures}
    return both.select("doc_id", *filled.values())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
