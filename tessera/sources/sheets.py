"""Readers and writers of sheets: delimited text, JSON arrays, lines, whole texts, file listings.

A sheet's cells are texts; ``typed`` gives each column the narrowest type that
fits all its cells.  Options are checked by the signatures: an unknown one is a
``TypeError``.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.values import kind, text


def _records(text: DataFrame, comment: str) -> DataFrame:
    """The lines of ``text`` (with ``value, _file, _at``) that are neither blank nor comments."""
    out = text.where(F.trim("value") != "")
    return out.where(~F.col("value").startswith(comment)) if comment else out


def _heads(rows: DataFrame) -> DataFrame:
    """``_file, _first``: the place of each file's first row; one small row a file."""
    own = rows.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
    return F.broadcast(own) if len(rows.inputFiles()) <= 100_000 else own


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, comment: str = "#", skip: int = 0, raw: bool = False, multiline: bool | None = None) -> DataFrame:
    """Records of a delimited file, or of a folder of files that each begin with the same header.

    ``skip`` drops each file's first records, counted after comments and blank
    lines are gone and before the header; they must lie in the file's first
    input split.  The header (that of the first file) gives the columns: shorter
    records are filled with empty cells, extra cells dropped; of columns of one
    name the last counts.  Without a header columns are ``c0, c1, ...``, as many
    as the widest record has.  Cells may hold quoted line feeds if ``multiline``,
    by default if some line has an odd number of quotes; a file is then read by
    one task.
    """
    if len(sep) != 1:
        raise ValueError("sep must be one character")
    comment = comment[:1]
    text = _records(_placed(spark.read.text(path)), comment)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if multiline is None or not header:
        seen = text.agg(F.bool_or(quotes % 2 == 1).alias("odd"), F.max(F.size(F.split("value", re.escape(sep)))).alias("wide")).first()
        multiline = bool(seen.odd) if multiline is None else multiline
    if header:
        at = _placed(spark.read.text(path)).join(_heads(text), "_file")
        lines = _records(at.where("_block = 0 and _at >= _first"), comment).orderBy("_file", "_at").select("value").limit(skip + 1).collect()
        cells = next(csv.reader([lines[skip].value.rstrip("\r")], delimiter=sep)) if len(lines) > skip else []
    else:
        cells = [f"c{i}" for i in range(seen.wide or 0)]
    if not cells:
        return spark.createDataFrame([], StructType([]))
    schema = StructType([StructField(f"_{i}", StringType()) for i in range(len(cells))])
    reader = spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", '"').option("header", False).option("multiLine", multiline)
    rows = _placed((reader.option("comment", comment) if comment else reader).csv(path))
    if header or skip:
        rows = rows.join(_heads(rows), "_file", "left").where((F.col("_block") != 0) | (F.col("_at") - F.col("_first") >= skip + header))
    names = {name: f"_{i}" for i, name in enumerate(cells)}
    if not header:  # separators inside quotes were counted
        held = rows.agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in names.values())).first()
        last = max((i for i, c in enumerate(names.values()) if held[c]), default=-1)
        names = dict(list(names.items())[: last + 1])
    out = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in names.items()))
    return out if raw else typed(out)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, **({"sep": "\t"} | options))


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, **({"sep": ","} | options))


_TYPES = {"bool": "boolean", "int": "bigint", "float": "double"}


def typed(df: DataFrame) -> DataFrame:
    """Each text column with the narrowest of boolean, bigint, double and string that fits all cells; empty cells keep it a string."""
    kinds = df.agg(*(F.collect_set(kind(F.col(f"`{c}`"))).alias(f"k{i}") for i, c in enumerate(df.columns))).first()
    out = []
    for i, c in enumerate(df.columns):
        seen = set(kinds[i] or ())
        to = next((_TYPES[k] for k in ("bool", "int") if seen == {k}), "double" if seen and seen <= {"int", "float"} else None)
        cell = F.col(f"`{c}`")
        out.append((cell.cast(to) if to else cell).alias(c))
    return df.select(*out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects; columns sorted by name, whole floats as integers, null as an empty text, nested values as JSON text."""
    start = spark.read.text(path, wholetext=True).select(F.ltrim("value").substr(1, 1)).first()
    if start is None or start[0] != "[":
        raise ValueError(f"{path}: not an array of objects")
    df = spark.read.option("multiLine", True).json(path)

    def cell(name: str, type_: str) -> Column:
        c = F.col(f"`{name}`")
        if type_.startswith(("struct", "array", "map")):
            return F.coalesce(F.to_json(c), F.lit(""))
        return F.coalesce(c, F.lit("")) if type_ == "string" else c

    out = df.select(*(cell(n, t).alias(n) for n, t in sorted(df.dtypes)))
    doubles = [n for n, t in out.dtypes if t == "double"]
    if doubles:
        whole = out.agg(*(F.bool_and(F.col(f"`{n}`") == F.floor(f"`{n}`")).alias(n) for n in doubles)).first()
        out = out.withColumns({n: F.col(f"`{n}`").cast("bigint") for n in doubles if whole[n]})
    return out


def read_lines(spark: SparkSession, path: str, comment: str = "", skip: int = 0, blank: bool = True) -> DataFrame:
    """``value`` of each line without its carriage return; ``skip`` counts all lines, comments are told by the trimmed text."""
    rows = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("value"))
    if skip:
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).where(F.col("_at") >= skip).drop("_at")
    if comment:
        rows = rows.where(~F.trim("value").startswith(comment))
    return rows if blank else rows.where(F.trim("value") != "")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """One path a line, trimmed, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, exists, mtime`` (nanoseconds) of the files in a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.lit(True).alias("exists"), (F.unix_micros("modificationTime") * 1000).alias("mtime"))


def file_kinds(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``path, exists, isfile, isdir`` of each path; a folder is what files lie under."""
    own = paths.select("path").distinct()
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    held = files.where("`exists`").select(plain.alias("path"))
    above = held.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), k), "/"))).alias("path"))
    out = own.join(held.distinct().withColumn("isfile", F.lit(True)), "path", "left").join(above.distinct().withColumn("isdir", F.lit(True)), "path", "left")
    out = out.select("path", F.coalesce("isfile", F.lit(False)).alias("isfile"), F.coalesce("isdir", F.lit(False)).alias("isdir"))
    return out.select("path", (F.col("isfile") | F.col("isdir")).alias("exists"), "isfile", "isdir")


def write_delimited(df: DataFrame, path: str, sep: str = "\t", append: bool = False) -> None:
    """Cells as texts; every part file has the header, which ``read_delimited`` expects."""
    cells = df.select(*(text(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes))
    cells.write.mode("append" if append else "overwrite").option("sep", sep).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """The columns of each row as texts, joined by a space, one row a line."""
    line = F.concat_ws(" ", *(text(F.col(f"`{c}`"), t) for c, t in df.dtypes)).alias("value")
    df.select(line).write.mode("append" if append else "overwrite").text(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def json_array(df: DataFrame) -> DataFrame:
    """One row, one column: a result as one JSON array of objects, for reports; the whole result must fit one text."""
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("json"))
