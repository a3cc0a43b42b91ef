"""The ledger as a stream: its folder is append-only, and records carry their own order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import FILES, SCHEMA, order


def records(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New records of the folder's files as they come; a compaction's files come as records seen before."""
    reader = spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").option("pathGlobFilter", FILES).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).where("job_id is not null and job_id <> ''")


def latest(stream: DataFrame) -> DataFrame:
    """The last record of each job so far; late and repeated records change nothing.  Use update or complete mode."""
    row = F.max_by(F.struct(*[c for c in stream.columns if c != "job_id"]), order())
    return stream.groupBy("job_id").agg(row.alias("_r")).select("job_id", "_r.*")


def owners(stream: DataFrame) -> DataFrame:
    """The owner of each path so far."""
    flat = stream.select(F.explode("outputs").alias("path"), "job_id", order().alias("_o"))
    return flat.groupBy("path").agg(F.max_by("job_id", "_o").alias("owner"))
