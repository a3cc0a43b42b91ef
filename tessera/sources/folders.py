"""Folders that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in this application's folder in ``spark.checkpoint.dir``, or in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")
    return f"{root}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: What is written to be read again soon is compressed so.
COMPRESSION = "zstd"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, so that its lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table is broadcast only if its rows, counted as text, hold so many bytes at most.
BROADCAST_BYTES = 32 << 20

#: The same for one that is as well joined by shuffling: Spark's own threshold, for rows instead of files.
JOIN_BYTES = 10 << 20

#: Types whose values Spark holds in eight bytes.
FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def small(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """``df`` (cheap to read, for it is measured), to be broadcast if it holds ``limit`` bytes at most, else never.

    Left to itself, Spark goes by the bytes of files, and millions of numbers in order
    take few of them; on the driver each is a row.  ``rows`` is their number if known.
    """
    size = 8 * (len(df.columns) + 1) * (df.count() if rows is None else rows)
    texts = [c for c, kind in df.dtypes if kind not in FIXED]
    if texts and size <= limit:
        size = max(size, df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0)
    return F.broadcast(df) if size <= limit else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, joined by shuffling whatever the size of its files, unless the other side is to be broadcast."""
    return df.hint("merge")


class Pile:
    """A table that grows by whole writes to one folder; what was written before is never written again."""

    def __init__(self, first: DataFrame, name: str):
        self._spark, self._schema, self._path, self._n = first.sparkSession, first.schema, scratch(first.sparkSession, name), 0
        self.first = self.add(first)

    def add(self, more: DataFrame) -> DataFrame:
        """Write ``more``; the rows written, read again."""
        path = f"{self._path}/{self._n}"
        more.write.parquet(path, compression=COMPRESSION)
        self._n += 1
        return self._spark.read.schema(self._schema).parquet(path)

    def now(self) -> DataFrame:
        return self._spark.read.schema(self._schema).option("recursiveFileLookup", "true").parquet(self._path)
