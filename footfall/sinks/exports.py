"""CSV and JDBC exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and ISO dates; one file per partition."""
    (df.write.mode("errorifexists").option("header", True)
     .option("dateFormat", "yyyy-MM-dd").csv(path))


def write_jdbc(df: DataFrame, url: str, table: str, *, block_rows: int = 1000,
               connections: int = 8, properties: Mapping[str, str] | None = None) -> None:
    """Append to a database table in blocks, over a bounded number of connections.

    Rows already written stay if a task is repeated or the job is run again: write to an
    empty staging table and move the rows in one statement of the database.
    """
    (df.repartition(connections).write.format("jdbc").mode("append")
     .options(url=url, dbtable=table, batchsize=str(block_rows), **dict(properties or {}))
     .save())
