"""Jump consistent hashing: a key and the number of shards decide the shard, without a ring table.

Growing from n to n + 1 shards moves about 1 / (n + 1) of the keys, all of them into the new shard.

Defined results: a null key counts as 0. Null text has 0 bytes and the checksum of empty bytes (0). Repeated rows
keep their number and get different slots. Empty tables give empty results. Other columns are kept by ``assign`` and
``write_shards`` whatever their names, except ``shard`` itself, which is replaced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytomesh.llm.common import number_rows, table

#: Fixed by the published algorithm: multiplier of its linear congruential generator.
MULTIPLIER = 2862933555777941757
#: Further such multipliers, for the order inside a shard: of the key, the size and the checksum.
ORDER_MULTIPLIER, SIZE_MULTIPLIER, CRC_MULTIPLIER = 3202034522624059733, 3935559000370003845, 2691343689449507681
TWO_64 = 18446744073709551616
#: Jumps that are unrolled for every key. Keys that need more (about log(shards) are usual) go on to the exact bound.
USUAL_JUMPS = 40
SHARDS = 24
#: Slots of equal rows that are written out together.
SPAN = 65_536


def _whole(number: int) -> Column:
    return F.lit(Decimal(number))


def _unsigned(key: Column) -> Column:
    return F.pmod(F.coalesce(key.cast("decimal(20,0)"), _whole(0)), _whole(TWO_64)).cast("decimal(20,0)")


def _times(key: Column, multiplier: int, plus: int) -> Column:
    """key * multiplier + plus modulo 2**64, in exact decimals: the product stays below 2**64 * 2**62 < 10**38."""
    product = (key * _whole(multiplier)).cast("decimal(38,0)")
    return ((product + _whole(plus)).cast("decimal(38,0)") % _whole(TWO_64)).cast("decimal(20,0)")


def _top31(key: Column) -> Column:
    """The leading 31 of 64 bits."""
    return F.floor(key / _whole(2**33)).cast("bigint")


def mixed31(key: Column, size: Column, crc: Column) -> Column:
    """A number in 0 .. 2**31 - 1 that spreads consecutive keys, and rows of one key, independent of the shard."""
    parts = [_times(_unsigned(c), m, 0) for c, m in ((key, ORDER_MULTIPLIER), (size, SIZE_MULTIPLIER), (crc, CRC_MULTIPLIER))]
    both = (parts[0] + parts[1] + parts[2]).cast("decimal(38,0)")
    return _top31((both % _whole(TWO_64)).cast("decimal(20,0)"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, 0 .. shards - 1) of a whole-number key.

    Each jump goes at least one shard on, so ``shards`` jumps always suffice; nearly all keys need few.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def jump(state: Column, _: Column) -> Column:
        grown = _times(state["key"], MULTIPLIER, 1)
        to = F.floor((state["to"] + 1) * (F.lit(2147483648.0) / (_top31(grown) + 1).cast("double"))).cast("bigint")
        moved = F.struct(grown.alias("key"), state["to"].alias("at"), to.alias("to"))
        return F.when(state["to"] < shards, moved).otherwise(state)

    start = F.struct(_unsigned(key).alias("key"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("to"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, USUAL_JUMPS))), start, jump)
    if shards > USUAL_JUMPS:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), first, jump)
        first = F.when(first["to"] < shards, rest).otherwise(first)
    return first["at"].cast("int")


def assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard``. String keys are hashed to 64 bits first; whole numbers are used as they are."""
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return df.withColumn("shard", jump_hash(F.col(key) if whole else F.xxhash64(key), shards))


def write_shards(df: DataFrame, key: str, shards: int, path: str, files_per_shard: int = 1) -> None:
    """Write the rows as Parquet below shard=0, shard=1, ...; every shard in about ``files_per_shard`` files."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    assign(df, key, shards).repartition(shards * files_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)


def shard_slots(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where every document goes: shard, place in it, and its shard if there were one more.

    Equal rows are counted before the shuffle, so a row repeated any number of times is one row there.
    """
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", n_bytes.alias("size"), crc.alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = rows.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "_o": mixed31(F.col("doc_id"), F.col("size"), F.col("text_crc32"))})
    # leading bits of the order cut each shard into buckets, which are summed up on their own
    bits = max(4, min(24, (docs.count() // (shards * 20_000)).bit_length() + 2))
    placed = placed.withColumn("_b", F.shiftright("_o", 31 - bits))
    run = F.sum("copies").over(W.partitionBy("shard", "_b").orderBy("_o", "doc_id", "size", "text_crc32"))
    counts = placed.groupBy("shard", "_b").agg(F.sum("copies").alias("_n"))
    starts = counts.select("shard", "_b", (F.sum("_n").over(W.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_start"))
    first = (F.col("_start") + F.col("_run") - F.col("copies")).alias("first")
    spans = placed.withColumn("_run", run).join(starts, ["shard", "_b"]).select("doc_id", "size", "text_crc32", "shard", "copies", first)
    # copies are dealt step by step, so arrays stay short
    last = F.col("first") + F.col("copies") - 1
    steps = spans.withColumn("_from", F.explode(F.sequence(F.col("first"), last, F.lit(SPAN))))
    slots = steps.withColumn("slot", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + SPAN - 1, last))))
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard")
    )


#: The checksum of the text has no SQL function here, so the bytes are folded one by one.
SHARDING_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, 0 AS k, i::UBIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY byte) AS c FROM bits WHERE k = 8),
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h,
         row_number() OVER () AS r FROM documents),
crcs AS (
  SELECT r, doc_id, size, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, size - 7), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::UBIGINT)),
    lambda a, b: xor(a >> 8, c[(xor(a, b) & 255)::BIGINT + 1])))::BIGINT AS text_crc32
  FROM docs, crc_table),
jumps AS (
  SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + {TWO_64}::HUGEINT) % {TWO_64}::HUGEINT AS key, -1::BIGINT AS cur, 0::BIGINT AS nxt FROM documents
  UNION ALL
  SELECT doc_id, (key * {MULTIPLIER}::HUGEINT + 1) % {TWO_64}::HUGEINT, nxt,
         floor((nxt + 1) * (2147483648::DOUBLE / ((((key * {MULTIPLIER}::HUGEINT + 1) % {TWO_64}::HUGEINT) >> 33) + 1)::DOUBLE))::BIGINT
  FROM jumps WHERE nxt < {SHARDS + 1}),
places AS (
  SELECT doc_id, max(cur) FILTER (WHERE cur < {SHARDS}) AS shard, max(cur) AS grown FROM jumps GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    (((coalesce(c.doc_id, 0)::HUGEINT + {TWO_64}::HUGEINT) % {TWO_64}::HUGEINT * {ORDER_MULTIPLIER}::HUGEINT % {TWO_64}::HUGEINT
      + size::HUGEINT * {SIZE_MULTIPLIER}::HUGEINT % {TWO_64}::HUGEINT + text_crc32::HUGEINT * {CRC_MULTIPLIER}::HUGEINT % {TWO_64}::HUGEINT) % {TWO_64}::HUGEINT) >> 33,
    c.doc_id, size, text_crc32) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM crcs c JOIN places p ON c.doc_id IS NOT DISTINCT FROM p.doc_id
"""


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(table(spark, sf_dir, "documents"))
