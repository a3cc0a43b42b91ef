"""Scheduler words, time and exit-code texts, and reconciliation of job states with files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schedulers' words and the state each stands for.
WORDS: dict[str, dict[str, tuple[str, ...]]] = {
    "slurm": {
        "queued": ("PENDING",),
        "running": ("RUNNING", "CONFIGURING", "COMPLETING", "RESIZING"),
        "done": ("COMPLETED",),
        "failed": ("FAILED", "CANCELLED", "TIMEOUT", "NODE_FAIL", "OUT_OF_MEMORY", "BOOT_FAIL", "DEADLINE", "PREEMPTED"),
    },
    "batchq": {
        "queued": ("USERHOLD", "WAITING", "QUEUED", "PROXYQUEUED"),
        "running": ("RUNNING",),
        "done": ("SUCCESS",),
        "failed": ("FAILED", "CANCELED"),
    },
    "sge": {"queued": ("qw", "hqw", "hRwq"), "running": ("r", "t", "Rr", "Rt", "s", "S", "T"), "failed": ("Eqw", "dr", "dt")},
    "pbs": {"queued": ("Q", "H", "W", "T"), "running": ("R", "E", "S"), "done": ("C",)},
}
#: The words of jobs that may still make their outputs.
ACTIVE: dict[str, tuple[str, ...]] = {
    "slurm": ("PENDING", "RUNNING"),
    "batchq": ("USERHOLD", "WAITING", "QUEUED", "PROXYQUEUED", "RUNNING"),
    "sge": ("qw", "hqw", "hRwq", "r", "t", "Rr", "Rt", "s", "S", "T"),
    "pbs": ("Q", "R", "H"),
}
#: What schedulers print where there is nothing.
PLACEHOLDERS = ("", "(null)", "None", "Unknown", "N/A")


def state(word: Column, scheduler: str) -> Column:
    """queued, running, done, failed, cancelled or unknown."""
    word = F.coalesce(word, F.lit(""))
    out = F.when(word.startswith("CANCELLED") | word.startswith("CANCELED"), "cancelled")
    for name, own in WORDS[scheduler].items():
        out = out.when(word.isin(*own), name)
    return out.otherwise("unknown")


def active(word: Column, scheduler: str, reason: Column | None = None) -> Column:
    """Whether a job may still make its outputs; not if it waits for a dependency that can never be met."""
    out = F.coalesce(word.isin(*ACTIVE[scheduler]), F.lit(False))
    return out if reason is None else out & (F.coalesce(reason, F.lit("")) != "DependencyNeverSatisfied")


def cleaned(c: Column) -> Column:
    """Trimmed; placeholders are empty."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))).isin(*PLACEHOLDERS), "").otherwise(F.trim(c))


def unbracketed(c: Column) -> Column:
    """Without what follows the first bracket."""
    return F.substring_index(c, "(", 1)


def probe_time(c: Column) -> Column:
    """Seconds since the epoch from an ISO time, epoch seconds or ``Mon Jan _2 15:04:05 2006``; null otherwise."""
    iso = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    ctime = F.try_to_timestamp(F.regexp_replace(F.substring(c, 5, 100), " +", " "), F.lit("MMM d HH:mm:ss yyyy"))
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint")), F.unix_timestamp(iso), F.unix_timestamp(ctime))


def exit_code(c: Column) -> Column:
    """The code of ``code:signal``; null if it is no number."""
    return F.split_part(F.trim(c), F.lit(":"), F.lit(1)).try_cast("int")


def rfc3339(seconds: Column) -> Column:
    """An ISO time in UTC; empty for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def reconcile(word: Column, state_: Column, submit: Column, end: Column, mtime: Column, slack: int = 300) -> Column:
    """State of an output: the scheduler's word while it is busy or failed, else what the file's time says."""
    there = F.coalesce(mtime >= submit, F.lit(False))
    fresh = there & (end.isNull() | (mtime <= end + slack))
    known = F.when(state_.isin("queued", "running", "failed", "cancelled"), word).when(state_ == "done", F.when(fresh, word).otherwise("DIRTY"))
    return known.otherwise(F.when(there, "COMPLETE").otherwise("DIRTY"))


def job_states(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """Jobs with ``native_state``, UNKNOWN where the probe has nothing."""
    return jobs.join(probes.select("job_id", "native_state", "end_time"), "job_id", "left").fillna("UNKNOWN", ["native_state"])


def aged_out(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """``owner, complete``: whether all paths that a job owns are there and no older than its submission.  ``outputs``: owner, path, submit_time."""
    held = outputs.join(files, "path", "left")
    ok = F.coalesce(F.col("exists"), F.lit(False)) & F.coalesce(F.col("mtime") >= F.col("submit_time"), F.lit(False))
    return held.groupBy("owner").agg(F.bool_and(ok).alias("complete"))


def enriched(jobs: DataFrame, details: DataFrame, owners: DataFrame, files: DataFrame) -> DataFrame:
    """One report row a job: what the ledger knows, with what the scheduler tells of it.

    ``details`` has ``job_id, detail`` (see ``details.DETAIL``).  The scheduler's
    submission time, folder and user count before the ledger's.  A job that the
    scheduler has forgotten is done if it owns paths, and all of them are there
    and no older than its submission; else its state is unknown.  Times are
    texts, empty if there are none.
    """
    outs = owners.join(jobs.select(F.col("job_id").alias("owner"), "submit_time"), "owner")
    left = aged_out(outs, files).withColumnRenamed("owner", "job_id")
    held = jobs.join(details, "job_id", "left").join(left, "job_id", "left")
    told, d = F.col("detail").isNotNull(), F.col("detail")

    def before(name: str, column: str):
        return F.coalesce(F.when(d[name] != F.lit(0 if name == "submit_time" else ""), d[name]), F.col(column))

    texts = [F.coalesce(d[n], F.lit("")).alias(n) for n in ("native_state", "reason", "elapsed", "time_limit", "nodes", "partition", "cpus", "mem_req", "mem_used", "account", "stdout_path", "stderr_path")]
    state_ = F.when(told, d["state"]).when(F.coalesce("complete", F.lit(False)), "done").otherwise("unknown")
    return held.select(
        "job_id", "array_id", F.when(F.coalesce("array_id", F.lit("")) != "", F.coalesce("task_index", F.lit(0))).alias("task_index"), "name", state_.alias("state"), d["exit_code"].alias("exit_code"), rfc3339(before("submit_time", "submit_time")).alias("submit_time"),
        rfc3339(d["start_time"]).alias("start_time"), rfc3339(d["end_time"]).alias("end_time"), before("user", "user").alias("user"), before("work_dir", "working_dir").alias("work_dir"), "deps", "pipeline", "run_id", *texts)


def owner_report(owners: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that own a path with their sorted paths, in order of submission."""
    held = owners.groupBy("owner").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return jobs.join(held, jobs.job_id == held.owner).drop("owner").orderBy("submit_time", "job_id")


def node_states(nodes: DataFrame, files: DataFrame, owners: DataFrame, states: DataFrame) -> DataFrame:
    """``name, state`` of graph nodes: Done if on disk, else their owner's state, else Pending.  ``states`` has ``job_id, state``."""
    held = nodes.select("name").join(files.where("`exists`").select(F.col("path").alias("name"), F.lit(True).alias("_disk")), "name", "left")
    held = held.join(owners.select(F.col("path").alias("name"), F.col("owner").alias("job_id")), "name", "left").join(states.select("job_id", F.col("state").alias("_state")), "job_id", "left")
    return held.select("name", F.when(F.col("_disk"), "Done").otherwise(F.coalesce("_state", F.lit("Pending"))).alias("state"))


def counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def table_lines(report: DataFrame) -> DataFrame:
    """``job_id, line``: id, state, name and, where there is one, reason, between tabs."""
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason"))
    return report.select("job_id", F.concat_ws("\t", "job_id", "state", F.coalesce("name", F.lit("")), reason).alias("line"))
