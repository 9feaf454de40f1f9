"""Tables that are published as a whole: readers see the old one or the new one.

A version is written to a folder of its own.  When that has succeeded, a small pointer
file with the folder's name is renamed over the one before, in one step of the file
system; the version before is kept for those who still read it, older ones go.  Meant for
tables that are rewritten as a whole, such as forecasts and rosters: a version costs a full
write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from footfall.sinks.keyed import merged_rows, without_nulls

POINTER = "_current"


class _Files:
    """Spark's own file system for a path, local or remote."""

    def __init__(self, spark: SparkSession, path: str):
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.spark, self.base = spark, hadoop.Path(path)
        self.Path, self.rename_options = hadoop.Path, hadoop.Options.Rename
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.base.getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), conf)

    def at(self, name: str):
        return self.Path(self.base, name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes ``text`` beside ``name`` and renames it over it, in one step."""
        fresh = self.at(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(fresh)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.spark._sc._gateway.new_array(self.rename_options, 1)
        options[0] = self.rename_options.OVERWRITE
        qualify = self.fs.makeQualified
        self.context.rename(qualify(fresh), qualify(self.at(name)), options)

    def versions(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.base)
                      if s.isDirectory() and s.getPath().getName().startswith("version-"))

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The version published last; empty when there was none.

    The frame stays with the version that it found, whatever is published meanwhile.
    """
    current = _Files(spark, path).read(POINTER)
    if current is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(
        f"{path.rstrip('/')}/{current.split()[0]}").select(*schema.names)


def publish(df: DataFrame, path: str, *, partition: str | None = None,
            before_pointer: Callable[[str], None] = lambda version: None) -> str:
    """Writes ``df`` as the next version of the table and publishes it; returns its name.

    A job that fails before the pointer is renamed leaves the published table as it was.
    The folder it wrote is removed by the next run that succeeds.  One writer at a time.
    ``before_pointer`` is called with the version's path when it is written.
    """
    files = _Files(df.sparkSession, path)
    held = (files.read(POINTER) or "").split()
    version = f"version-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(f"{path.rstrip('/')}/{version}")
    before_pointer(f"{path.rstrip('/')}/{version}")
    files.replace(POINTER, "\n".join([version, *held[:1]]))  # what is read, what was before
    for old in files.versions():
        if old not in (version, *held[:1]):
            files.remove(old)
    return version


def upsert_published(new: DataFrame, path: str, *, schema: T.StructType, key: Sequence[str],
                     update: Sequence[str], partition: str | None = None,
                     arrival: Sequence[Column] | None = None, **options) -> str:
    """Merges rows into a published table: a whole new version, seen all at once."""
    target = read_published(new.sparkSession, path, schema)
    merged = merged_rows(without_nulls(new, list(key)), target, key, update, arrival=arrival)
    return publish(merged, path, partition=partition, **options)
