"""An append-only job ledger: folds, ownership, search, dump and compaction.

Records are ordered by (ts, host, pid, seq), not by arrival, so logs may be
read in any order and more than once.  A ledger is a folder of files of JSON
lines; folders can lie in any store that Spark reaches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lists import any_contains
from ..sources.folders import settled

SCHEMA = (
    "ts long, seq long, host string, pid int, job_id string, run_id string, name string, pipeline string, working_dir string, user string, submit_time long, "
    "outputs array<string>, temp map<string,boolean>, inputs array<string>, deps array<string>, script string, settings map<string,string>, array_id string, task_index int"
)


def order() -> Column:
    return F.struct("ts", "host", "pid", "seq")


#: Files of a ledger: logs of other writers end in ``.jsonl``, Spark's in ``.json``.
FILES = "*.{jsonl,json}"


def _folder(spark: SparkSession, folder: str):
    """The folder's store and path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _files(spark: SparkSession, folder: str) -> list[str]:
    store, path = _folder(spark, folder)
    if not store.exists(path):
        return []
    if store.getFileStatus(path).isFile():
        raise NotADirectoryError(f"{folder}: a ledger is a folder")
    names = [x.getPath().getName() for x in store.listStatus(path) if x.isFile()]
    return sorted(n for n in names if n.endswith((".jsonl", ".json")) and not n.startswith(("_", ".")))


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(paths).where("job_id is not null and job_id <> ''")


def read(spark: SparkSession, folder: str, snapshot: bool = False) -> DataFrame:
    """Every well-formed record of the files that the folder has now; broken lines and records without an id are left out.

    A folder that isn't there is an empty ledger; a file raises.  With
    ``snapshot`` the records are copied, so a compaction may run meanwhile.
    """
    out = _records(spark, [f"{folder}/{n}" for n in _files(spark, folder)])
    return settled(out, "ledger") if snapshot else out


def append(records: DataFrame, folder: str) -> None:
    """Add records; every task writes a file of its own, so writers need no lock."""
    records.write.mode("append").option("compression", "none").json(folder)


def latest(records: DataFrame, key: str = "job_id", by: Column | None = None) -> DataFrame:
    """The last record of each key."""
    row = F.max_by(F.struct(*[c for c in records.columns if c != key]), order() if by is None else by)
    return records.groupBy(key).agg(row.alias("_r")).select(key, "_r.*")


def owners(records: DataFrame, key: str = "job_id", outputs: str = "outputs", by: Column | None = None) -> DataFrame:
    """``path, owner``: for each output path the last job that declared it, whatever that job's own last record says."""
    flat = records.select(F.explode(outputs).alias("path"), key, (order() if by is None else by).alias("_o"))
    return flat.groupBy("path").agg(F.max_by(key, "_o").alias("owner"))


def owner_of(records: DataFrame, path: str) -> DataFrame:
    return owners(records.where(F.array_contains("outputs", path))).where(F.col("path") == path)


def search(jobs: DataFrame, id_: str | None = None, name: str | None = None, input_: str | None = None, output: str | None = None, script: str | None = None) -> DataFrame:
    """Jobs that meet all given tests: id exact or as array id, the others as parts of the text."""
    out = jobs
    if id_ is not None:
        out = out.where((F.col("job_id") == id_) | (F.col("array_id") == id_))
    for column, part in (("name", name), ("script", script)):
        if part is not None:
            out = out.where(F.contains(F.col(column), F.lit(part)))
    for column, part in (("inputs", input_), ("outputs", output)):
        if part is not None:
            out = out.where(any_contains(F.col(column), part))
    return out


def vacuum(records: DataFrame) -> DataFrame:
    """The last record of each job that still owns a path, with its order columns."""
    live = owners(records).select(F.col("owner").alias("job_id")).distinct()
    return latest(records.join(live, "job_id", "left_semi")).select(*records.columns)


def compact(spark: SparkSession, folder: str) -> None:
    """Replace the files that the folder has now by the records that ``vacuum`` keeps of them.

    The new files are written beside and moved in before the old ones go, and
    only files that were read go.  So records appended meanwhile stay, and a
    reader in between, or a run that was cut short, sees some records twice,
    which changes nothing.
    """
    old = _files(spark, folder)
    if not old:
        return
    store, path = _folder(spark, folder)
    made = f"_compact-{uuid.uuid4().hex}"
    vacuum(settled(_records(spark, [f"{folder}/{n}" for n in old]), "compact")).write.option("compression", "none").json(f"{folder}/{made}")
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    for x in store.listStatus(new_path(path, made)):
        if x.getPath().getName().startswith("part-"):
            store.rename(x.getPath(), new_path(path, f"snapshot{made}-{x.getPath().getName()}"))
    store.delete(new_path(path, made), True)
    for n in old:
        store.delete(new_path(path, n), False)


def dump(jobs: DataFrame) -> DataFrame:
    """``job_id, k_ord, pos, key, value``: facts of each job as rows; empty ones are left out, but not empty script lines."""
    none = F.array().cast("array<string>")
    sorted_out = F.array_sort(F.coalesce("outputs", none))
    mark = F.transform(sorted_out, lambda p: F.struct(F.when(F.coalesce(F.col("temp")[p], F.lit(False)), "TEMP").otherwise("OUTPUT").alias("key"), p.alias("value")))

    def one(key: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))

    def many(key: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))

    task = F.when(F.coalesce("array_id", F.lit("")) != "", F.coalesce("task_index", F.lit(0)))
    set_ = F.transform(F.array_sort(F.map_entries(F.coalesce("settings", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("\t"), F.coalesce(e["value"], F.lit(""))))
    lines = F.when(F.trim(F.regexp_replace(F.coalesce("script", F.lit("")), r"\s", "")) == "", none).otherwise(F.split(F.rtrim("script", F.lit("\n")), "\n"))
    groups = [
        *(one(k, F.col(c)) for k, c in (("PIPELINE", "pipeline"), ("WORKINGDIR", "working_dir"), ("RUNID", "run_id"), ("NAME", "name"), ("USER", "user"), ("ARRAY", "array_id"))),
        one("TASKINDEX", task), one("SUBMIT", F.when(F.col("submit_time") != 0, F.col("submit_time"))), many("DEP", F.col("deps")), mark, many("INPUT", F.col("inputs")), many("SRC", lines), many("SETTING", set_),
    ]
    out = jobs.select("job_id", "submit_time", F.posexplode(F.array(*groups)).alias("k_ord", "g")).select("job_id", "submit_time", "k_ord", F.posexplode("g").alias("pos", "e"))
    return out.select("job_id", "submit_time", "k_ord", "pos", "e.key", "e.value").where("key = 'SRC' or coalesce(value, '') <> ''")


def writer_of(file: Column) -> Column:
    """(host, pid, nanos, n) of a log file's name, read from the right."""
    at = r"([^/]*)-(\d+)-(\d+)-(\d+)\.jsonl$"
    return F.struct(*(F.regexp_extract(file, at, i).alias(n) for i, n in enumerate(("host", "pid", "nanos", "n"), 1)))


def reusable(outputs: DataFrame, owner: DataFrame, active: DataFrame) -> DataFrame:
    """``rule_id, job_id``: the active owner of the first declared output that has one.  ``outputs`` has ``rule_id, pos, path``."""
    held = outputs.join(owner, "path").join(active.select(F.col("job_id").alias("owner")), "owner", "left_semi")
    return held.groupBy("rule_id").agg(F.min_by("owner", "pos").alias("job_id"))


def external(inputs: DataFrame, files: DataFrame, owner: DataFrame, active: DataFrame) -> DataFrame:
    """``path, owner``: missing inputs that an active job will make."""
    missing = inputs.select("path").distinct().join(files.where("`exists`"), "path", "left_anti")
    return missing.join(owner, "path").join(active.select(F.col("job_id").alias("owner")), "owner", "left_semi")
