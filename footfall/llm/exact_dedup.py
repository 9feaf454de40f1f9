"""Exact duplicates by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted externally, so
equal texts become neighbours; neighbours are compared in full and the smallest
identifier stays.  The splitters are the first 64 characters, then a 64-bit hash of the
whole text: bounded, however long the texts, and a head that many texts share is still
spread.  Only the whole text decides.

A text with more than ``slice_rows`` copies is sorted in several slices, told by the
identifier.  Their heads, one for each slice, are compared in full afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import settled, table

HEAD = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty text."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"),
                   F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text))


def exact_dedup(docs: DataFrame, slice_rows: int = 1000) -> DataFrame:
    """One row per document: who stays of its group, and how large the group is.

    Null texts equal empty ones.  ``keep_id`` is the smallest non-null id of the group;
    rows without an id stay only where no row of the group has one.  Of rows with the
    same id and text exactly one stays.  Only ``doc_id`` and ``text`` are read, so other
    columns may have any names.  An empty table gives an empty result.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn(
        "hash", F.xxhash64("norm"))
    heavy = settled(rows.groupBy("hash").count().where(F.col("count") > slice_rows)
                    .select("hash", F.ceil(F.col("count") / slice_rows).alias("slices")),
                    "copies-counted")
    spread = (rows.join(heavy, "hash", "left")
              .withColumn("slices", F.coalesce("slices", F.lit(1)))
              .withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit("slice")), "slices"))
              .withColumn("head", F.substring("norm", 1, HEAD)))
    # the window needs no further exchange: its keys contain those of the ranges
    equal = Window.partitionBy("head", "hash", "slice", "norm")
    first = F.row_number().over(equal.orderBy(F.asc_nulls_last("doc_id"))) == 1
    compared = settled(
        spread.repartitionByRange("head", "hash", "slice")
        .select("doc_id", "slices", "norm", first.alias("first"),
                F.min("doc_id").over(equal).alias("least"),
                F.count("*").over(equal).alias("rows"))
        .select("doc_id", "slices", "first", "least", "rows",
                F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                F.when(F.col("first") & (F.col("slices") > 1), F.col("norm")).alias("norm")),
        "content-sorted")
    merged = (compared.where(F.col("norm").isNotNull()).groupBy("text_sha256", "norm")
              .agg(F.min("least").alias("all_least"), F.sum("rows").alias("all_rows"))
              .drop("norm"))
    keep = F.when(F.col("all_rows").isNull(), F.col("least")).otherwise(F.col("all_least"))
    return (compared.drop("norm").join(merged, "text_sha256", "left")
            .select("doc_id", keep.alias("keep_id"),
                    F.coalesce("all_rows", "rows").alias("group_size"),
                    (F.col("first") & F.col("least").eqNullSafe(keep)).alias("kept"),
                    "text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
