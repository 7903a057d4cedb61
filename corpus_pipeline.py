"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame, which is written as
Parquet and read again for the next one. All but the last return the columns of their input.

1. language: documents without a known language, or too unlike the profile of every language, go. A missing ``lang`` is
   filled with the prediction; given ones stay.
2. quality: lines that fail the line rules go, then documents that fail the base rules or lost too much text.
3. near_duplicates: of every group of near-duplicates one row stays, the one with the smallest id.
4. mixing: documents are taken as often as the target of their source asks for, up to twice.
5. packing: token sequences of at most 2,048 ids, one row per piece with its ids and its place.

Stages keep extra columns, null ids, repeated rows and empty tables as their operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import langid, mixing, neardup, packing, quality
from cytomesh.llm.common import table, written

#: Cosine with the nearest profile below which a text counts as no language.
MIN_COSINE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = langid.predict(docs.select(own, "text"), langid.profiles(docs.select("text", "lang")))
    good = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_COSINE))
    filled = {"lang": F.coalesce("row.lang", "lang_pred")}
    return good.select(*[filled.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL expresses the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
