"""Helpers that several operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (local tests), a folder in the warehouse takes
    its place.  All that an application writes for itself lies in the one
    folder, which can go when the application has ended.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")
    return f"{root}/tessera-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table is broadcast only if its rows, counted as text, hold so many bytes at most.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (settled, for it is read to be measured), to be broadcast if it holds ``limit`` bytes at most."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def apart(key: Column) -> Column:
    """A bijection of an integer key, for a join of rows with what was aggregated by the same key.

    Joined by the key itself, both sides would keep the aggregation's partitions,
    which the adaptive plan can't split where one key has very many rows.
    """
    return key.bitwiseXOR(F.lit(0x5851F42D4C957F2D))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
