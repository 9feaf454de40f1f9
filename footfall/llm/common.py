"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.session import work_dir

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that Spark hands to Python at once.
DOCUMENTS = 500


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared working folder and read again.

    It is computed once, however many later steps use it, its lineage ends at files that
    outlive an executor, and its size on disk lets Spark choose broadcasts by measure.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # where the package isn't installed, a local session's workers find it beside this file
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """64 bits of a row's id and text, beside ``doc_id`` to tell rows apart that share an id."""
    return F.xxhash64("doc_id", "text", F.lit("row"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` for helper columns, changed where ``df`` has columns of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def without_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``rejected`` (doc_id, row_key); all columns are kept."""
    key, one, other = unused(docs, "row__key", "one__id", "one__key")
    gone = rejected.select(F.col("doc_id").alias(one), F.col("row_key").alias(other))
    return docs.withColumn(key, row_key()).join(
        gone, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(key) == F.col(other)),
        "left_anti").select(*docs.columns)


def ranked(df: DataFrame, order: list[Column], name: str, rank: str) -> DataFrame:
    """``df`` with the 0-based position of each row in ``order``, without one task for all.

    Rows are range-partitioned and sorted; a row's rank is its position in its partition
    plus the rows of all partitions before, a running sum over one row per partition.
    """
    local = (1 << 33) - 1  # monotonically_increasing_id: partition number, then position
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    before = (placed.groupBy(part).agg(F.count("*").alias("__n"))
              .select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))
                      .alias("__before")))
    return (placed.withColumn("__part", F.shiftright("__at", 33)).join(before, "__part")
            .withColumn(rank, F.col("__before") + F.col("__at").bitwiseAND(F.lit(local)))
            .drop("__at", "__part", "__before"))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, by remainder."""
    return (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
                   F.lit(modulus)) == remainder)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 most: int = 1 << 23) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut to about ``most`` bytes of text, each with its texts as bytes.

    Null texts count as empty.  A single longer text forms a batch of its own.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        out: list[bytes] = []
        for i in range(len(texts)):
            text = texts[i]
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if out and size + len(data) > most:
                yield batch.slice(start, i - start), out
                start, size, out = i, 0, []
            out.append(data)
            size += len(data)
        if out:
            yield batch.slice(start), out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what runs inside, so that long rows don't
    add up to a batch of many megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
