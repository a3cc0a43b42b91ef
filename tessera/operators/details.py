"""Job details from the texts that schedulers print: one struct for all of them.

Each function reads a column with one job's text (``sacct`` a table with a line
a row) and gives a struct of the fields of ``DETAIL``; null where the text tells
of no job.  Times are seconds since the epoch, 0 if absent; absent texts are
empty, and an absent exit code is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import once
from .status import cleaned, exit_code, probe_time, state, unbracketed

DETAIL = (
    "native_state string, state string, reason string, exit_code int, submit_time bigint, start_time bigint, end_time bigint, elapsed string, time_limit string, nodes string, partition string, "
    "cpus string, mem_req string, mem_used string, account string, user string, work_dir string, stdout_path string, stderr_path string"
)
#: The columns of an accounting line, in the order in which they are asked for.
SACCT = ("JobID", "State", "ExitCode", "Submit", "Start", "End", "Elapsed", "NodeList", "Partition", "ReqCPUS", "ReqMem", "MaxRSS", "Account", "User", "Timelimit")
#: The schedulers' names of plain text fields; of several the first that holds something counts.
SCONTROL = {
    "reason": ("Reason",), "elapsed": ("RunTime",), "time_limit": ("TimeLimit",), "nodes": ("NodeList",), "partition": ("Partition",), "cpus": ("NumCPUs",), "mem_req": ("ReqMem", "MinMemoryNode", "MinMemoryCPU"),
    "account": ("Account",), "work_dir": ("WorkDir",), "stdout_path": ("StdOut",), "stderr_path": ("StdErr",),
}
SACCT_TEXTS = {"elapsed": "Elapsed", "time_limit": "Timelimit", "nodes": "NodeList", "partition": "Partition", "cpus": "ReqCPUS", "mem_req": "ReqMem", "account": "Account", "user": "User"}
QSTAT_F = {
    "elapsed": ("resources_used.walltime",), "time_limit": ("Resource_List.walltime",), "mem_used": ("resources_used.mem",), "mem_req": ("Resource_List.mem", "Resource_List.pmem"),
    "cpus": ("Resource_List.ncpus", "Resource_List.nodect", "Resource_List.nodes"), "nodes": ("exec_host",), "partition": ("queue",), "account": ("Account_Name",), "user": ("Job_Owner",),
    "stdout_path": ("Output_Path",), "stderr_path": ("Error_Path",),
}
QSTAT_J = {"user": ("owner",), "work_dir": ("sge_o_workdir",), "account": ("account",), "mem_req": ("hard_resource_list",), "stdout_path": ("stdout_path_list",), "stderr_path": ("stderr_path_list",)}
QACCT = {"nodes": ("hostname",), "partition": ("qname",), "user": ("owner",), "account": ("account",), "mem_used": ("maxvmem",), "elapsed": ("ru_wallclock",)}
BATCHQ = {
    "nodes": ("host", "exec_host", "node", "nodes"), "partition": ("queue", "partition"), "cpus": ("procs", "cpus", "ncpus"), "mem_req": ("mem", "mem_req"), "mem_used": ("mem_used", "maxvmem"), "time_limit": ("walltime", "time_limit"),
    "reason": ("reason",), "account": ("account",), "user": ("user", "owner"), "work_dir": ("wd", "work_dir", "cwd", "workdir"), "stdout_path": ("stdout", "stdout_path"), "stderr_path": ("stderr", "stderr_path"),
}
_BATCHQ_JSON = "array<struct<job_id:string,status:string,name:string,submit_time:string,start_time:string,end_time:string,return_code:int,details:map<string,string>,running_details:map<string,string>>>"


def _split_at(line: Column, mark: str) -> Column:
    """``key, value`` around the first ``mark``, both trimmed."""
    return F.named_struct(F.lit("key"), F.trim(F.substring_index(line, mark, 1)), F.lit("value"), F.trim(F.substring(line, F.instr(line, mark) + len(mark), F.length(line))))


def _pairs(lines: Column, mark: str) -> Column:
    return F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(mark))), lambda x: _split_at(x, mark))


def _read(pairs: Column, body) -> Column:
    """``body`` of the keys and values, the last first, cut once a row."""

    def turned(p: Column) -> Column:
        return F.named_struct(F.lit("keys"), F.reverse(F.transform(p, lambda x: x["key"])), F.lit("values"), F.reverse(F.transform(p, lambda x: x["value"])))

    return once(once(pairs, turned), body)


def _value(read: Column, *names: str) -> Column:
    """The last value of the first name that holds one; else empty."""
    found = [F.get(read["values"], F.array_position(read["keys"], n).cast("int") - 1) for n in names]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.lit(""))


def _detail(**known: Column) -> Column:
    parts = []
    for field in DETAIL.split(", "):
        name, type_ = field.split(" ")
        absent = F.lit(None) if name == "exit_code" else F.lit(0) if type_ == "bigint" else F.lit("")
        value = known.get(name, absent)
        parts += [F.lit(name), (F.coalesce(value, absent) if name != "exit_code" else value).cast(type_)]
    return F.named_struct(*parts)


def _texts(read: Column, names: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    return {k: once(_value(read, *n), cleaned) for k, n in names.items()}


def _time(c: Column) -> Column:
    return once(c, lambda x: probe_time(cleaned(x)))


def scontrol(text: Column) -> Column:
    """From ``Key=Value`` tokens between blanks."""

    def of(p: Column) -> Column:
        word = _value(p, "JobState")
        times = {k: _time(_value(p, n)) for k, n in (("submit_time", "SubmitTime"), ("start_time", "StartTime"), ("end_time", "EndTime"))}
        own = _detail(native_state=word, state=once(word, lambda w: state(w, "slurm")), user=once(unbracketed(_value(p, "UserId")), cleaned), exit_code=exit_code(_value(p, "ExitCode")), **times, **_texts(p, SCONTROL))
        return F.when(word != "", own)

    return _read(_pairs(F.split(F.trim(text), r"\s+"), "="), of)


def sacct(lines: DataFrame) -> DataFrame:
    """``job_id, detail`` from accounting lines (``job_id, line``), fields between bars: the job's own row, and the first memory use of any step."""
    cells = lines.select("job_id", F.split("line", r"\|").alias("f")).where(F.size("f") >= len(SACCT))
    at = {n: F.col("f")[i] for i, n in enumerate(SACCT)}
    own = F.col("job_id") == at["JobID"]
    word = F.regexp_extract(F.trim(at["State"]), r"^(\S*)", 1)
    times = {k: _time(at[n]) for k, n in (("submit_time", "Submit"), ("start_time", "Start"), ("end_time", "End"))}
    row = _detail(native_state=word, state=state(word, "slurm"), exit_code=exit_code(at["ExitCode"]), **times, **{k: cleaned(at[n]) for k, n in SACCT_TEXTS.items()})
    used = F.nullif(cleaned(at["MaxRSS"]), F.lit(""))
    per = cells.groupBy("job_id").agg(F.max(F.when(own, row)).alias("detail"), F.min(F.when(used.isNotNull(), F.struct(at["JobID"].alias("step"), used.alias("used")))).alias("mem"))
    return per.where("detail is not null").select("job_id", F.col("detail").withField("mem_used", F.coalesce("mem.used", F.lit(""))).alias("detail"))


def qstat_f(text: Column) -> Column:
    """From ``key = value`` lines; a line that begins with a tab goes on with the one before."""

    def of(p: Column) -> Column:
        word, code = _value(p, "job_state"), F.trim(_value(p, "Exit_status")).try_cast("int")
        times = {"submit_time": _time(_value(p, "qtime", "ctime")), "start_time": _time(_value(p, "stime")), "end_time": F.when(code.isNotNull(), _time(_value(p, "mtime")))}
        return F.when(word != "", _detail(native_state=word, state=once(word, lambda w: state(w, "pbs")), exit_code=code, **times, **_texts(p, QSTAT_F)))

    return _read(_pairs(F.split(F.replace(text, F.lit("\n\t"), F.lit("")), "\n"), " = "), of)


def qstat_j(word: Column, text: Column) -> Column:
    """Of a listed job: its state's word, and ``key: value`` lines."""
    p = F.transform(_pairs(F.split(F.coalesce(text, F.lit("")), "\n"), ":"), lambda x: F.named_struct(F.lit("key"), F.replace(x["key"], F.lit(" "), F.lit("_")), F.lit("value"), x["value"]))
    return F.when(word != "", _read(p, lambda q: _detail(native_state=word, state=state(word, "sge"), **_texts(q, QSTAT_J))))


def qacct(text: Column) -> Column:
    """Of a finished job: lines of a key, blanks and a value; the exit code tells the state."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))

    def of(p: Column) -> Column:
        code = F.regexp_extract(_value(p, "exit_status"), r"^(\S*)", 1).try_cast("int")
        ended = F.when(code == 0, "done").when(code.isNotNull(), "failed")
        return F.when(F.size(p["keys"]) > 0, _detail(native_state=ended, state=F.coalesce(ended, F.lit("unknown")), exit_code=code, **_texts(p, QACCT)))

    return _read(_pairs(F.filter(lines, lambda x: ~x.startswith("=")), " "), of)


def batchq(job_id: Column, text: Column) -> Column:
    """From a JSON array of records: that of the id, else the first.  A code counts once the job has ended."""

    def of(j: Column) -> Column:
        def either(*keys: str) -> Column:
            found = [once(F.coalesce(F.try_element_at(j[m], F.lit(k)), F.lit("")), lambda x: F.nullif(cleaned(x), F.lit(""))) for k in keys for m in ("running_details", "details")]
            return F.coalesce(*found, F.lit(""))

        word = F.coalesce(j["status"], F.lit(""))
        times = {k: F.unix_timestamp(F.try_to_timestamp(j[k])) for k in ("submit_time", "start_time", "end_time")}
        ended = F.when(word.isin("SUCCESS", "FAILED", "CANCELED"), F.coalesce(j["return_code"], F.lit(0)))
        return F.when(word != "", _detail(native_state=word, state=state(word, "batchq"), exit_code=ended, **times, **{f: either(*k) for f, k in BATCHQ.items()}))

    def chosen(records: Column) -> Column:
        return once(F.coalesce(F.get(F.filter(records, lambda r: r["job_id"] == job_id), F.lit(0)), F.get(records, F.lit(0))), of)

    return once(F.from_json(text, _BATCHQ_JSON), chosen)
