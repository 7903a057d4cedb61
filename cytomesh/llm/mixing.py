"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed position in 0 .. 2**60 - 1, a digest of its id and text. A source takes the documents below
a threshold of that position, so a smaller budget takes a subset of what a larger one takes. The threshold is found by
sums of sizes in 4,096 buckets of the position; only the bucket that holds the budget is cut again, until it holds one
position. Nothing is sorted by position. A target above the size of its source takes every document once (or twice)
and the rest of the budget from a threshold.

Defined results: null text has size 0; the null source is a source of its own, last in order. A document is taken when
the middle of its words lies within the budget, so documents of size 0 go along with their neighbours. Rows repeated
with one id and text share a position; as many of them are taken as the budget needs. Empty tables give empty results.
Input columns are kept; ``size``, ``source_size``, ``target`` and ``taken`` are replaced if they exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.llm.common import WORD, delete, is_small, join_small, table, written

#: Production parameters, fixed by the task.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: Bits of the position that one pass of histograms tells apart; five passes tell all 60.
BITS = 12
POSITION_BITS = 60


def position(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, excess over ``limit`` times the size reshared.

    ``sizes`` has one row per source. Weights repeat along the sources by code point, null last. Sources at their limit
    are fixed round by round, and the driver sees three sums a round.
    """
    # A distributed rank: sources fall into ranges; a range is numbered on its own and shifted by the ranges before it.
    ranges = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_p", F.spark_partition_id())
    ranges = written(ranges)
    ends = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p"))
    starts = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", (ends - F.col("_n")).alias("_start"))
    rank = F.col("_start") + F.row_number().over(W.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranges.join(F.broadcast(starts), "_p").withColumn("_rank", rank).withColumn("_w", weight)
    cap = F.col("source_size") * F.lit(float(limit))
    ranked = written(ranked.select("source", "source_size", "_w", cap.alias("_cap")))
    delete(ranges)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, fixed = float(total) * share, None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("_w") * F.lit(level) > F.col("_cap")
        n, at_cap, open_weight = ranked.agg(
            F.sum(capped.cast("int")), F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w")))
        ).first()
        if n == fixed or not open_weight:
            break
        fixed, level = n, (budget - at_cap) / open_weight
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level or 0.0))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: repeats of every document, the boundary position, and the words still free before it.

    ``rows`` (source, size, pos) is a written table. Returns source, source_size, target, reps, edge, room.
    """
    small = is_small(targets)
    reps = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("bigint")
    state = targets.withColumn("reps", reps).withColumn("room", F.col("target") - F.col("reps") * F.col("source_size"))
    state = written(state.withColumn("edge", F.lit(0).cast("bigint")))
    for shift in range(POSITION_BITS - BITS, -1, -BITS):
        # only rows inside the boundary bucket of their source take part
        inside = join_small(rows, state.select("source", "edge"), ["source"], "inner", small)
        inside = inside.where(F.shiftright("pos", shift + BITS) == F.col("edge")).withColumn("b", F.shiftright("pos", shift))
        sums = inside.groupBy("source", "b").agg(F.sum("size").alias("words"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        w = W.partitionBy("source").orderBy("b")  # at most 2**BITS rows a source
        upto = sums.withColumn("upto", F.sum("words").over(w))
        hit = join_small(upto, state.select("source", "room"), ["source"], "inner", small)
        last = F.row_number().over(W.partitionBy("source").orderBy("b"))
        hit = hit.where(F.col("upto") > F.col("room")).withColumn("_k", last).where("_k = 1")
        hit = hit.select("source", "b", (F.col("upto") - F.col("words")).alias("before"), "lo", "hi")
        nxt = join_small(state, hit, ["source"], "left", small)
        # a source whose budget lies behind its last document keeps an edge after every position
        done = nxt.select(
            "source", "source_size", "target", "reps",
            (F.col("room") - F.coalesce("before", F.lit(0))).alias("room"),
            F.coalesce("b", F.lit(1).cast("bigint") * 2 ** (POSITION_BITS - shift)).alias("edge"),
            (F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("_open"), F.col("lo"),
        )
        done = written(done)
        delete(state)
        open_left = not done.where("_open").isEmpty()
        state = done.drop("_open", "lo")
        if not open_left:
            edge = F.coalesce("lo", F.lit(2**POSITION_BITS).cast("bigint"))
            return done.select("source", "source_size", "target", "reps", edge.alias("edge"), "room")
    return state


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The rows with ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted) and ``copies``."""
    added = ["size", "source_size", "target", "taken", "copies"]
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row")
    sized = docs.select(own, "source", size.alias("size"), position(F.col("doc_id"), F.col("text")).alias("pos"))
    rows = written(sized.select("source", "size", "pos"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = thresholds(rows, source_targets(sizes, weights, share, limit))
    joined = join_small(sized, found, ["source"], "inner")
    plain = joined.where("pos <> edge").withColumn("copies", F.col("reps") + (F.col("pos") < F.col("edge")).cast("bigint"))
    # one position a source is left: equal rows, counted before the shuffle
    ties = joined.where("pos = edge").groupBy(*joined.columns).agg(F.count(F.lit(1)).alias("n"))
    words = F.col("n") * F.col("size")
    before = F.sum(words).over(W.partitionBy("source", "pos").orderBy("row")) - words
    extra = F.when(F.col("size") > 0, F.floor((F.col("room") - before) / F.col("size") + 0.5)).otherwise(F.lit(0))
    ties = ties.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), extra)).cast("bigint"))
    ties = ties.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    ties = ties.withColumn("copies", F.col("reps") + (F.col("i") <= F.col("extra")).cast("bigint"))
    # texts without words cost nothing, so nothing but the limit bounds their copies
    most = F.least(F.col("copies"), F.lit(int(limit))).alias("copies")
    out = ["row.*", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), most]
    return plain.select(*out).unionByName(ties.select(*out))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mixed_row")
    taken = mix(docs.select(own, "doc_id", "text", "source"), **parameters).where("copies > 0")
    return taken.select("mixed_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("mixed_row.*")


MIXING_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS pos
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0 * sum(size)::DOUBLE AS cap
  FROM sized GROUP BY source),
levels AS (
  SELECT 0 AS i, (SELECT 1.5 * sum(source_size) / sum(w) FROM sources)::DOUBLE AS level
  UNION ALL
  SELECT i + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(cap) FILTER (WHERE w * level > cap), 0)) / sum(w) FILTER (WHERE w * level <= cap) FROM sources)
  FROM levels WHERE i < 60),
targets AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM levels WHERE i = 60)) AS target FROM sources),
ordered AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS reps,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (reps + CASE WHEN target - reps * source_size >= before + size / 2.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
