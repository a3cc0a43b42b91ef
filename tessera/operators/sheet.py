"""Scatter, gather and grouping of ordered rows.  ``order`` names the columns whose order is the rows' order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.strings import placeholders
from ..sources.folders import settled, small
from .graph import up_to_date


def scatter(df: DataFrame, list_col: str, as_: str, index: str | None = None) -> DataFrame:
    """A row for each element of a list, with its number from 1 if asked for."""
    if index is None:
        return df.select("*", F.explode(list_col).alias(as_))
    return df.select("*", F.posexplode(list_col).alias(index, as_)).withColumn(index, F.col(index) + 1)


def numbered(df: DataFrame, key: list[str], order: list[str], as_: str = "i") -> DataFrame:
    """Rows numbered from 1 in the order of each key."""
    return df.withColumn(as_, F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def ordered_list(value: Column, order: list[str]) -> Column:
    """Aggregate: the values as a list in the rows' order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.transform(pairs, lambda p: p["_v"])


def enumerated(df: DataFrame, order: list[str], as_: str = "n") -> DataFrame:
    """All rows numbered from 1 in order, without bringing them together.

    Rows are dealt by ranges and sorted within each; a range's numbers begin
    after the sizes of the ranges before it, one small row each.
    """
    dealt = settled(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "enumerated")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(as_, F.col("_start") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_size", "_first", "_start")


def enumerated_within(df: DataFrame, key: list[str], order: list[str], as_: str = "n") -> DataFrame:
    """Rows numbered from 1 in the order of each key, however many rows a key has; null keys are one key."""
    own = enumerated(df, [*key, *order], "_n")
    first = settled(own.groupBy(*key).agg(F.min("_n").alias("_first")).withColumns({f"_k{i}": F.col(k) for i, k in enumerate(key)}).drop(*key), "first")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)), F.lit(True))
    placed = own.join(small(first), same) if key else own.crossJoin(F.broadcast(first))
    return placed.withColumn(as_, F.col("_n") - F.col("_first") + 1).select(*df.columns, as_)


def group_gather(df: DataFrame, key: str, value: str, order: list[str], as_: str = "items") -> DataFrame:
    """A row for each key with its values in order; ``first`` is the key's first place.

    A key's list is one value, so this is for keys whose lists fit a task;
    ``gather_blocks`` has no such bound.
    """
    return df.groupBy(key).agg(ordered_list(F.col(value), order).alias(as_), F.min(F.struct(*order)).alias("first"))


def gather_blocks(df: DataFrame, key: list[str], value: str, order: list[str], size: int = 10_000, as_: str = "items") -> DataFrame:
    """The keys' values in order, ``size`` to a row: the key, ``block`` from 0, and the list.  Without a key, all rows are one.

    However many rows a key has, they are sorted by ranges of (key, order), and
    no row of the result holds more than ``size`` values.
    """
    places = [f"_o{i}" for i in range(len(order))]
    own = enumerated_within(df.select(*key, F.col(value).alias("_v"), *(F.col(c).alias(p) for c, p in zip(order, places, strict=True))), key, places, "_at")
    block = F.floor((F.col("_at") - 1) / size).alias("block")
    return own.groupBy(*key, block).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda p: p["_v"]).alias(as_))


def gather(df: DataFrame, value: str, order: list[str], as_: str = "items") -> DataFrame:
    """One row with all values in order: for tables whose list fits a task; else ``gather_blocks`` without a key."""
    return df.agg(ordered_list(F.col(value), order).alias(as_))


def running_total(df: DataFrame, key: list[str], order: list[str], value: str, as_: str = "total") -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(as_, F.sum(value).over(w))


def last_value(df: DataFrame, key: list[str], order: list[str], value: str, as_: str = "last") -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(as_))


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def products(*sides: DataFrame) -> DataFrame:
    """Every combination of the rows of tables that state a query (template lists): as many rows as the reader asks for."""
    return reduce(lambda a, b: a.crossJoin(b), sides)


#: Ranges without a key are joined into one text in blocks of so many numbers.
RANGE_BLOCK = 1 << 16


def ranges(df: DataFrame, key: list[str], number: str, as_: str = "spec") -> DataFrame:
    """Numbers of each key as text ``1-3,5``: consecutive ones are one range.

    Without a key, all rows are one, in one row (null if there are none): they
    are numbered and joined in blocks, so only the blocks' texts meet in a task.
    """
    own = df.select(*key, F.col(number).cast("long").alias("_n"))
    own = (own.repartition(*key) if key else own).distinct()  # by key, for all that follows is by key
    at = own.withColumn("_at", F.row_number().over(W.partitionBy(*key).orderBy("_n"))) if key else enumerated(own, ["_n"], "_at")
    runs = at.groupBy(*key, (F.col("_n") - F.col("_at")).alias("_g")).agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", "_a", "_b"))

    def joined(text: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", text.alias("t")))), lambda x: x["t"]), ",")

    if key:
        return runs.groupBy(*key).agg(joined(one).alias(as_))
    blocks = runs.groupBy(F.floor(F.col("_a") / RANGE_BLOCK).alias("_block")).agg(F.min("_a").alias("_a"), joined(one).alias("_t"))
    return blocks.agg(F.when(F.count(F.lit(1)) > 0, joined(F.col("_t"))).alias(as_))


def fan_out(files: DataFrame, command: str, outputs: list[str], inputs: list[str], disk: DataFrame) -> DataFrame:
    """``n, path, command, outs, ins, skipped``: a job for each file, with the placeholders filled.

    ``files`` has ``n, path`` (see ``enumerated``).  A job is skipped if its
    outputs are all there and no older than its inputs, the file among them;
    jobs without outputs never are.  ``ranges`` over the others gives the array
    specification.  ``disk`` has ``path, exists, mtime``.
    """
    path, n = F.col("path"), F.col("n")
    none = F.array().cast("array<string>")
    jobs = settled(files.select("n", "path", placeholders(command, path, n).alias("command"), (F.array(*(placeholders(o, path, n) for o in outputs)) if outputs else none).alias("outs"), F.array(path, *(placeholders(i, path, n) for i in inputs)).alias("ins")), "jobs")
    times = disk.where("`exists`").select(F.col("path").alias("file"), "mtime")

    def stated(column: str) -> DataFrame:
        return jobs.select(F.col("n").alias("key"), F.explode(column).alias("file")).join(times, "file", "left").select("key", "mtime")

    ok = up_to_date(stated("outs"), stated("ins")).where("ok").select(F.col("key").alias("n"), F.lit(True).alias("skipped"))
    return jobs.join(ok, "n", "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
