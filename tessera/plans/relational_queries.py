"""Queries over rows in order, ledgers, states and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lists, strings
from ..operators import details, graph, ledger, sheet, status
from ..sources.folders import scratch, settled, shuffled
from .scalar_queries import c, load


def micros(t):
    """Microseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), t)


def seconds(t):
    return F.floor(micros(t) / 1_000_000).cast("bigint")


def group_gather(spark, d):
    """Every event's id by type, in order, in blocks of a thousand."""
    out = sheet.gather_blocks(load(spark, d, "events").select("event_type", "event_id", c("event_id").cast("string").alias("v")), ["event_type"], "v", ["event_id"], 1000)
    return out.select("event_type", c("block").cast("bigint").alias("block"), F.sha2(lists.join(c("items"), " "), 256).alias("ids_sha256"), F.size("items").cast("bigint").alias("n"))


def group_lists(spark, d):
    """The nations of each region, a list a region."""
    out = sheet.group_gather(load(spark, d, "nation"), "n_regionkey", "n_name", ["n_nationkey"])
    return out.select(c("n_regionkey").cast("bigint").alias("n_regionkey"), lists.join(c("items"), " ").alias("names"), c("first.n_nationkey").cast("bigint").alias("first_key"))


def gather_all(spark, d):
    """Every order's key in order of date, in blocks."""
    out = sheet.gather_blocks(load(spark, d, "orders"), [], "o_orderkey", ["o_orderdate", "o_orderkey"], 4096)
    return out.select(c("block").cast("bigint").alias("block"), F.sha2(lists.join(c("items"), ",", "bigint"), 256).alias("keys_sha256"), F.size("items").cast("bigint").alias("n"))


def scatter_index(spark, d):
    own = sheet.numbered(load(spark, d, "supplier"), ["s_nationkey"], ["s_suppkey"])
    parts = sheet.scatter(own.withColumn("l", F.array(F.lit("sum"), F.lit("log"))), "l", "kind", "k")
    return parts.select("s_suppkey", c("i").cast("bigint").alias("i"), c("k").cast("bigint").alias("k"), strings.template("out_", c("s_name"), ".", c("kind")).alias("path"))


def running_total(spark, d):
    own = load(spark, d, "orders").withColumn("cents", F.round(c("o_totalprice") * 100).cast("bigint"))
    return sheet.running_total(own, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents").select("o_orderkey", "cents", "total")


def last_value(spark, d):
    return sheet.last_value(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "last_type")


def _log(spark, d):
    """Events as ledger records: a job a user, an output path for each kind of event of the user."""
    path = F.concat_ws("/", "event_type", c("user_id").cast("string"))
    return load(spark, d, "events").select(
        (micros(c("ts")) * 1000).alias("ts"), c("event_id").alias("seq"), F.lit("h").alias("host"), F.lit(1).alias("pid"), c("event_id").cast("string").alias("job_id"), F.lit("r").alias("run_id"),
        c("event_type").alias("name"), F.lit("p").alias("pipeline"), F.lit("/w").alias("working_dir"), c("user_id").cast("string").alias("user"), seconds(c("ts")).alias("submit_time"),
        F.array(path).alias("outputs"), F.create_map(path, c("event_type") == "click").alias("temp"), F.array(F.concat(path, F.lit(".in"))).alias("inputs"), F.array().cast("array<string>").alias("deps"),
        F.when(c("event_id") % 2 == 0, F.concat(F.lit("echo "), c("event_type"), F.lit("\n\ndone\n"))).otherwise("").alias("script"), F.create_map(F.lit("mem"), F.lit("8G")).alias("settings"),
        F.when(c("event_id") % 10 == 0, F.concat(F.lit("arr"), (c("event_id") / 100).cast("bigint").cast("string"))).otherwise("").alias("array_id"), (c("event_id") % 7).cast("int").alias("task_index"))


def ledger_latest(spark, d):
    return ledger.latest(_log(spark, d), "user").select(c("user").alias("user_name"), "job_id", "name", "submit_time")


def ledger_owner(spark, d):
    return ledger.owners(_log(spark, d))


def ledger_vacuum(spark, d):
    return ledger.vacuum(_log(spark, d)).select("job_id", "user", "ts", "seq").withColumnRenamed("user", "user_name")


def ledger_search(spark, d):
    jobs = ledger.latest(_log(spark, d))
    one = ledger.search(jobs, name="ic", output="/1", input_=".in", script="echo").select("job_id", F.lit("filters").alias("how"))
    return one.union(ledger.search(jobs, id_="arr3").select("job_id", F.lit("array").alias("how"))).union(ledger.search(jobs, id_="17").select("job_id", F.lit("id").alias("how")))


def ledger_dump(spark, d):
    return ledger.dump(ledger.latest(_log(spark, d))).select("job_id", "key", "value", c("pos").cast("bigint").alias("pos"))


def ledger_roundtrip(spark, d):
    folder = scratch(spark, "ledger")
    log = _log(spark, d)
    ledger.append(log, folder)
    ledger.append(log, folder)
    return ledger.owners(ledger.read(spark, folder, snapshot=True))


def ledger_compact(spark, d):
    """Two halves of the log, each appended twice, compacted in between and at the end; then what is left."""
    folder = scratch(spark, "ledger")
    log = _log(spark, d)
    for half in (0, 1):
        ledger.append(log.where(F.col("seq") % 2 == half), folder)
        ledger.append(log.where(F.col("seq") % 2 == half), folder)
        ledger.compact(spark, folder)
    return ledger.read(spark, folder).select("job_id", "user", "ts", "seq").withColumnRenamed("user", "user_name")


def ledger_owner_of(spark, d):
    return ledger.owner_of(_log(spark, d), "click/7")


def log_names(spark, d):
    """Writers of log files, from names whose host has hyphens."""
    name = F.concat(F.lit("/led/node-"), c("n_nationkey").cast("string"), F.lit("-x-"), (c("n_nationkey") * 31).cast("string"), F.lit("-1700000000-"), c("n_regionkey").cast("string"), F.lit(".jsonl"))
    own = ledger.writer_of(name)
    return load(spark, d, "nation").select("n_nationkey", own["host"].alias("host"), own["pid"].alias("pid"), own["n"].alias("nth"))


def status_normalise(spark, d):
    """Cleaned fields, codes, users and times of probe texts."""
    word = F.when(c("o_orderstatus") == "P", "PENDING").when(c("o_orderstatus") == "F", "COMPLETED").when(c("o_orderkey") % 3 == 0, "CANCELLED by 7").when(c("o_orderkey") % 3 == 1, "OUT_OF_MEMORY").otherwise("")
    return load(spark, d, "orders").select(
        "o_orderkey", status.state(word, "slurm").alias("state"), status.active(word, "slurm", F.when(c("o_orderkey") % 5 == 0, "DependencyNeverSatisfied")).alias("is_active"),
        status.cleaned(F.when(c("o_orderkey") % 2 == 0, "(null)").otherwise(" a ")).alias("cleaned"), status.exit_code(F.concat((c("o_orderkey") % 9).cast("string"), F.lit(":0"))).cast("bigint").alias("code"),
        status.unbracketed(F.lit("alice(1001)")).alias("login"), status.rfc3339(seconds(c("o_orderdate"))).alias("at"), status.probe_time(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("seconds"))


STATUS_NORMALISE = """select o_orderkey, case when o_orderstatus = 'P' then 'queued' when o_orderstatus = 'F' then 'done' when o_orderkey % 3 = 0 then 'cancelled' when o_orderkey % 3 = 1 then 'failed' else 'unknown' end state,
o_orderstatus = 'P' and o_orderkey % 5 <> 0 is_active,
case when o_orderkey % 2 = 0 then '' else 'a' end cleaned, (o_orderkey % 9)::bigint code, 'alice' login, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') "at", epoch(o_orderdate)::bigint "seconds" from orders"""
#: Every word of the schedulers with its state and whether the job is active, written out for the SQL; the word of an order is drawn by its key.
_WORDS = {
    "slurm": "PENDING queued 1,RUNNING running 1,CONFIGURING running 0,COMPLETING running 0,RESIZING running 0,COMPLETED done 0,FAILED failed 0,CANCELLED cancelled 0,TIMEOUT failed 0,NODE_FAIL failed 0,OUT_OF_MEMORY failed 0,BOOT_FAIL failed 0,DEADLINE failed 0,PREEMPTED failed 0,other unknown 0",
    "batchq": "USERHOLD queued 1,WAITING queued 1,QUEUED queued 1,PROXYQUEUED queued 1,RUNNING running 1,SUCCESS done 0,FAILED failed 0,CANCELED cancelled 0,other unknown 0",
    "sge": "qw queued 1,hqw queued 1,hRwq queued 1,r running 1,t running 1,Rr running 1,Rt running 1,s running 1,S running 1,T running 1,Eqw failed 0,dr failed 0,dt failed 0,other unknown 0",
    "pbs": "Q queued 1,H queued 1,W queued 0,T queued 0,R running 1,E running 0,S running 0,C done 0,other unknown 0",
}


def status_words(spark, d):
    """Every word of every scheduler, and one that none knows."""
    out = None
    for scheduler, listed in _WORDS.items():
        words = F.array(*(F.lit(x.split(" ")[0]) for x in listed.split(",")))
        word = F.get(words, F.pmod(c("o_orderkey"), F.size(words)).cast("int"))
        one = load(spark, d, "orders").select("o_orderkey", F.lit(scheduler).alias("scheduler"), word.alias("word")).select("*", status.state(c("word"), scheduler).alias("state"), status.active(c("word"), scheduler).alias("is_active"))
        out = one if out is None else out.union(one)
    return out


STATUS_WORDS = " union all ".join(
    f"select o_orderkey, '{scheduler}' scheduler, w.word, w.state, w.act = 1 is_active from orders join (values {', '.join(f'({i}, ' + chr(39) + x.split(' ')[0] + chr(39) + ', ' + chr(39) + x.split(' ')[1] + chr(39) + ', ' + x.split(' ')[2] + ')' for i, x in enumerate(listed.split(',')))}) w(i, word, state, act) on o_orderkey % {len(listed.split(','))} = w.i"
    for scheduler, listed in _WORDS.items()
)


def _said(spark, d):
    """Orders as jobs, with a text of each kind of probe for each."""
    key, at = c("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    old = F.concat(F.date_format("o_orderdate", "E MMM "), F.lpad(F.date_format("o_orderdate", "d"), 2, " "), F.date_format("o_orderdate", " HH:mm:ss yyyy"))
    ended = c("o_orderkey") % 2 == 0
    slurm = F.concat(F.lit("JobId="), key, F.lit(" JobName=a=b UserId=u"), c("o_custkey").cast("string"), F.lit("(77)  Account=(null) JobState="), F.when(ended, "TIMEOUT").otherwise("RUNNING"), F.lit(" Reason=None ExitCode="), (c("o_orderkey") % 3).cast("string"), F.lit(":9 SubmitTime="), at, F.lit(" StartTime=Unknown NumCPUs=4 MinMemoryCPU=2G WorkDir=/w/"), key)
    pbs = F.concat(F.lit("Job Id: "), key, F.lit("\n    job_state = "), F.when(ended, "C").otherwise("R"), F.lit("\n    Job_Owner = u@h\n    Output_Path = h:/long/\n\tpath\n    Resource_List.nodect = 2\n    resources_used.mem = 10kb\n    qtime = "), old, F.when(ended, F.concat(F.lit("\n    Exit_status = 271\n    mtime = "), F.unix_timestamp("o_orderdate").cast("string"))).otherwise(""))
    sge = F.concat(F.lit("owner:     o"), key, F.lit("\nsge_o_workdir:  /w\nhard resource_list:  h_vmem=4G\naccount: None"))
    acct = F.concat(F.lit("==============================================================\nqname        all.q\nhostname     n1\nowner        o"), key, F.lit("\nexit_status  "), (c("o_orderkey") % 3).cast("string"), F.lit("  \nmaxvmem      1.5G"))
    queue = F.concat(F.lit('[{"job_id":"x","status":"QUEUED"},{"job_id":"'), key, F.lit('","status":"'), F.when(ended, "FAILED").otherwise("RUNNING"), F.lit('","return_code":3,"submit_time":"'), at, F.lit('Z","details":{"procs":"8","mem":"N/A","host":"d"},"running_details":{"host":"h'), key, F.lit('"}}]'))
    return load(spark, d, "orders").select("o_orderkey", key.alias("job_id"), "o_orderdate", slurm.alias("slurm"), pbs.alias("pbs"), sge.alias("sge"), acct.alias("acct"), queue.alias("queue"))


def details_told(spark, d):
    """What each scheduler's text says of a job."""
    said, own = _said(spark, d), None
    for kind, told in (("scontrol", details.scontrol(c("slurm"))), ("qstat_f", details.qstat_f(c("pbs"))), ("qstat_j", details.qstat_j(F.lit("hqw"), c("sge"))), ("qacct", details.qacct(c("acct"))), ("batchq", details.batchq(c("job_id"), c("queue")))):
        one = said.select("o_orderkey", F.lit(kind).alias("kind"), F.explode(F.array(told)).alias("detail"))
        own = one if own is None else own.union(one)
    return own.select("o_orderkey", "kind", *((F.coalesce(c(f"detail.{n}").cast("bigint"), F.lit(-1)) if t in ("int", "bigint") else c(f"detail.{n}")).alias(f"d_{n}") for n, t in (f.split(" ") for f in details.DETAIL.split(", "))))


DETAILS_TOLD = """with o as (select o_orderkey k, o_orderkey % 2 = 0 e, epoch(o_orderdate)::bigint t, o_custkey u from orders)
select k o_orderkey, 'scontrol' kind, case when e then 'TIMEOUT' else 'RUNNING' end d_native_state, case when e then 'failed' else 'running' end d_state, '' d_reason, (k % 3)::bigint d_exit_code, t d_submit_time, 0::bigint d_start_time, 0::bigint d_end_time, '' d_elapsed, '' d_time_limit, '' d_nodes, '' d_partition, '4' d_cpus, '2G' d_mem_req, '' d_mem_used, '' d_account, 'u' || u d_user, '/w/' || k d_work_dir, '' d_stdout_path, '' d_stderr_path from o
union all select k, 'qstat_f', case when e then 'C' else 'R' end, case when e then 'done' else 'running' end, '', case when e then 271 else -1 end, t, 0, case when e then t else 0 end, '', '', '', '', '2', '', '10kb', '', 'u@h', '', 'h:/long/path', '' from o
union all select k, 'qstat_j', 'hqw', 'queued', '', -1, 0, 0, 0, '', '', '', '', '', 'h_vmem=4G', '', '', 'o' || k, '/w', '', '' from o
union all select k, 'qacct', case when k % 3 = 0 then 'done' else 'failed' end, case when k % 3 = 0 then 'done' else 'failed' end, '', k % 3, 0, 0, 0, '', '', 'n1', 'all.q', '', '', '1.5G', '', 'o' || k, '', '', '' from o
union all select k, 'batchq', case when e then 'FAILED' else 'RUNNING' end, case when e then 'failed' else 'running' end, '', case when e then 3 else -1 end, t, 0, 0, '', '', 'h' || k, '', '8', '', '', '', '', '', '', '' from o"""


def details_accounted(spark, d):
    """Accounting lines: a row for the job, rows for its steps, and broken ones."""
    key = c("o_orderkey").cast("string")

    def line(id_, word, used):
        return F.concat_ws("|", id_, word, F.lit("1:0"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), *map(F.lit, ("Unknown", "", "00:10", "n[1-2]", "long", "4", "8G")), used, *map(F.lit, ("acc", "", "1-00")))

    lines = F.array(line(key, F.lit("CANCELLED by 1001"), F.lit("")), line(F.concat(key, F.lit(".batch")), F.lit("FAILED"), F.concat(key, F.lit("K"))), line(F.concat(key, F.lit(".extern")), F.lit("FAILED"), F.lit("9K")), F.lit("broken|line"))
    out = details.sacct(load(spark, d, "orders").select(key.alias("job_id"), F.explode(lines).alias("line")))
    return out.select("job_id", *(c(f"detail.{n}").alias(f"d_{n}") for n in ("native_state", "state", "submit_time", "start_time", "elapsed", "nodes", "mem_used", "account", "user")), c("detail.exit_code").cast("bigint").alias("d_exit_code"))


DETAILS_ACCOUNTED = "select o_orderkey::varchar job_id, 'CANCELLED' d_native_state, 'cancelled' d_state, epoch(o_orderdate)::bigint d_submit_time, 0::bigint d_start_time, '00:10' d_elapsed, 'n[1-2]' d_nodes, o_orderkey || 'K' d_mem_used, 'acc' d_account, '' d_user, 1::bigint d_exit_code from orders"


def job_report(spark, d):
    """The ledger's jobs with what the scheduler still knows of some of them."""
    log = _log(spark, d)
    jobs = ledger.latest(log)
    text = F.concat(F.lit("JobState=RUNNING Reason=Priority UserId=root(0) ExitCode=0:0 SubmitTime="), F.when(c("task_index") == 1, "Unknown").otherwise("2020-01-02T03:04:05"))
    told = jobs.where("task_index < 3").select("job_id", details.scontrol(text).alias("detail"))
    files = load(spark, d, "customer").select(F.concat(F.lit("click/"), c("c_custkey").cast("string")).alias("path"), F.lit(True).alias("exists"), F.lit(4_000_000_000).alias("mtime"))
    out = status.enriched(jobs, told, ledger.owners(log), files)
    lines = status.table_lines(out)
    return out.join(lines, "job_id").select("job_id", "state", F.coalesce(c("exit_code"), F.lit(-1)).cast("bigint").alias("exit_code"), "submit_time", c("user").alias("user_name"), "work_dir", "reason", "line", F.coalesce(c("task_index"), F.lit(-1)).cast("bigint").alias("task"))


def job_modes(spark, d):
    """Jobs with the probe's word, UNKNOWN without one."""
    jobs = load(spark, d, "orders").select(c("o_orderkey").alias("job_id"))
    probes = load(spark, d, "orders").where("o_orderstatus <> 'O'").select(c("o_orderkey").alias("job_id"), c("o_orderpriority").alias("native_state"), F.lit(1).alias("end_time"))
    return status.job_states(jobs, probes).select("job_id", "native_state")


def node_counts(spark, d):
    """States of the graph's nodes, counted."""
    nodes = load(spark, d, "orders").select(F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("name"))
    owner = load(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("path"), c("o_orderkey").alias("owner"))
    states = load(spark, d, "orders").where("o_orderkey % 9 <> 0").select(c("o_orderkey").alias("job_id"), c("o_orderpriority").alias("state"))
    return status.counts(status.node_states(nodes, _files(spark, d), owner, states))


def status_reconcile(spark, d):
    own = load(spark, d, "orders").join(load(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    submit, made = seconds(c("o_orderdate")), seconds(c("l_shipdate"))
    state = F.when(c("o_orderstatus") == "P", "running").when(c("o_orderstatus") == "F", "done").otherwise("unknown")
    word = F.when(c("o_orderstatus") == "P", "RUNNING").when(c("o_orderstatus") == "F", "COMPLETED").otherwise("")
    end = F.when(c("l_linenumber") % 2 == 0, submit + 40 * 86400)
    return own.groupBy("o_orderkey").agg(*(F.sum((status.reconcile(word, state, submit, end, made) == w).cast("bigint")).alias(w.lower()) for w in ("RUNNING", "COMPLETED", "COMPLETE", "DIRTY")))


STATUS_RECONCILE = """with x as (select o_orderkey, o_orderstatus s, epoch(l_shipdate) >= epoch(o_orderdate) there, l_linenumber % 2 = 1 or epoch(l_shipdate) <= epoch(o_orderdate) + 40 * 86400 + 300 early from orders join lineitem on o_orderkey = l_orderkey)
select o_orderkey, count(*) filter (where s = 'P')::bigint running, count(*) filter (where s = 'F' and there and early)::bigint completed, count(*) filter (where s not in ('P', 'F') and there)::bigint complete,
count(*) filter (where (s = 'F' and not (there and early)) or (s not in ('P', 'F') and not there))::bigint dirty from x group by 1"""


def owner_report(spark, d):
    log = _log(spark, d)
    return status.owner_report(ledger.owners(log), ledger.latest(log)).select("job_id", "submit_time", lists.join(c("paths"), " ").alias("paths"))


def aged_out(spark, d):
    log = _log(spark, d)
    outs = ledger.owners(log).join(ledger.latest(log).select(c("job_id").alias("owner"), "submit_time"), "owner")
    files = load(spark, d, "customer").select(F.concat(F.lit("click/"), c("c_custkey").cast("string")).alias("path"), F.lit(True).alias("exists"), F.lit(4_000_000_000).alias("mtime"))
    return status.aged_out(outs, files)


def _lineage(spark, d):
    """Edges region, nation, customer, order, line."""

    def pair(name, a, pa, b, pb):
        return load(spark, d, name).select(F.concat(F.lit(pa), c(a).cast("string")).alias("src"), F.concat(F.lit(pb), c(b).cast("string")).alias("dst"))

    line = load(spark, d, "lineitem").select(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("src"), F.concat_ws("_", F.concat(F.lit("l"), c("l_orderkey").cast("string")), c("l_linenumber").cast("string")).alias("dst"))
    out = pair("nation", "n_regionkey", "r", "n_nationkey", "n").union(pair("customer", "c_nationkey", "n", "c_custkey", "c")).union(pair("orders", "o_custkey", "c", "o_orderkey", "o")).union(line)
    return out.distinct()


_EDGES = """edges as (select distinct * from (select 'r' || n_regionkey src, 'n' || n_nationkey dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer
union all select 'c' || o_custkey, 'o' || o_orderkey from orders union all select 'o' || l_orderkey, 'l' || l_orderkey || '_' || l_linenumber from lineitem))"""


def graph_sources(spark, d):
    return graph.sources(_lineage(spark, d))


def graph_nodes_edges(spark, d):
    e = _lineage(spark, d)
    return graph.nodes(e).select(F.substring("name", 1, 1).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).union(e.select(F.lit("edges")).groupBy("edges").agg(F.count(F.lit(1))))


def graph_reach(spark, d):
    return graph.reachable(_lineage(spark, d), load(spark, d, "lineitem").agg(F.max_by(F.concat_ws("_", F.concat(F.lit("l"), c("l_orderkey").cast("string")), c("l_linenumber").cast("string")), F.struct("l_orderkey", "l_linenumber"))))


def graph_layers(spark, d):
    return graph.layers(_lineage(spark, d)).select("name", c("layer").cast("bigint").alias("layer"))


def graph_places(spark, d):
    """Each node's layer and its row in it, by name."""
    own = sheet.enumerated_within(graph.layers(_lineage(spark, d)), ["layer"], ["name"], "place")
    return own.select("name", c("layer").cast("bigint").alias("layer"), c("place").cast("bigint").alias("place"))


def graph_dot(spark, d):
    e = load(spark, d, "nation").select(c("n_regionkey").cast("string").alias("src"), c("n_name").alias("dst"))
    n = graph.nodes(e).join(graph.sources(e).withColumn("source", F.lit(True)), "name", "left").select("name", F.lit(False).alias("temp"), F.coalesce("source", F.lit(False)).alias("source"))
    return graph.dot(n, e).select("line", c("ord").cast("bigint").alias("ord"))


def wildcard_match(spark, d):
    rules = spark.createDataFrame([(1, "small %"), (2, "% ring"), (3, "%l%"), (4, "b%e"), (5, "plain")], "rule_id long, pattern string")
    return graph.wildcard_matches(rules, load(spark, d, "part").select(c("p_name").alias("path")).distinct())


def wildcard_rules(spark, d):
    rules = spark.createDataFrame([(1, ["%.bam", "%.log"], ["%.fq", "ref.fa"])], "rule_id long, outputs array<string>, inputs array<string>")
    stems = load(spark, d, "part").select(F.lit(1).cast("long").alias("rule_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("stem"))
    return graph.instantiated(rules, stems).select("stem", lists.join(c("outputs"), " ").alias("made"), lists.join(c("inputs"), " ").alias("needed"))


def first_candidate(spark, d):
    own = load(spark, d, "lineitem").select(c("l_partkey").alias("path"), c("l_suppkey").alias("rule_id"), c("l_suppkey").alias("ord"), (c("l_suppkey") % 7 == 0).alias("wildcard")).distinct()
    good = load(spark, d, "supplier").select(c("s_suppkey").alias("rule_id"), (c("s_acctbal") > 5000).alias("ok"))
    return graph.first_candidate(own.join(good, "rule_id")).select("path", "rule_id", "ok")


def _rules(spark, d):
    """Orders as rules: made from their customer's file; customers' files from their nation's."""
    orders = load(spark, d, "orders").select(c("o_orderkey").alias("rule_id"), F.array(F.concat(F.lit("o"), c("o_orderkey").cast("string"))).alias("outputs"), F.array(F.concat(F.lit("c"), c("o_custkey").cast("string"))).alias("inputs"))
    cust = load(spark, d, "customer").select((-c("c_custkey") - 1).alias("rule_id"), F.array(F.concat(F.lit("c"), c("c_custkey").cast("string"))).alias("outputs"), F.array(F.concat(F.lit("n"), c("c_nationkey").cast("string"))).alias("inputs"))
    both = orders.union(cust)
    return both.select("rule_id", "outputs", "inputs", F.create_map(F.get("outputs", F.lit(0)), F.pmod("rule_id", F.lit(5)) == 0).alias("temp"), F.lit(True).alias("has_body"))


def _files(spark, d):
    orders = load(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("path"), (seconds(c("o_orderdate")) - 600000000).alias("mtime"))
    cust = load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("path"), (c("c_custkey") * 100000).alias("mtime"))
    nat = load(spark, d, "nation").where("n_nationkey <> 3").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("path"), (c("n_nationkey") * 4000000).cast("bigint").alias("mtime"))
    return orders.union(cust).union(nat).select("path", F.lit(True).alias("exists"), "mtime")


def staleness(spark, d):
    return graph.staleness(_rules(spark, d), _files(spark, d)).select("rule_id", "will_run", F.coalesce("eff", F.lit(-1)).alias("eff"))


_STALE = """nat as (select n_nationkey, case when n_nationkey <> 3 then n_nationkey * 4000000 end t from nation),
cu as (select c_custkey, c_nationkey, case when c_custkey % 3 <> 0 then c_custkey * 100000 end f, ((-c_custkey - 1) % 5 + 5) % 5 = 0 is_temp, t newest from customer join nat on c_nationkey = n_nationkey),
cs as (select *, (f is null and not is_temp) or coalesce(f < newest, false) run, coalesce(f, newest) eff from cu),
oo as (select o_orderkey, case when o_orderkey % 4 <> 0 then epoch(o_orderdate)::bigint - 600000000 end f, o_orderkey % 5 = 0 is_temp, run irun, eff newest, o_custkey from orders join cs on o_custkey = c_custkey),
os as (select *, irun or (f is null and not is_temp) or coalesce(f < newest, false) run, coalesce(f, newest) eff from oo)"""


def to_build(spark, d):
    rules, files = _rules(spark, d), _files(spark, d)
    return graph.to_build(rules, graph.staleness(rules, files), files)


def satisfiable(spark, d):
    return graph.satisfiable(_rules(spark, d), _files(spark, d))


def _chained(spark, d):
    """Lines of an order as rules, each made from the line before it and a part's file; every fourth gathers only."""
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    line = line.withColumn("before", F.lag("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber")))
    name = F.concat_ws("_", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    made = F.array_compact(F.array(F.when(c("before").isNotNull(), F.concat_ws("_", c("l_orderkey").cast("string"), c("before").cast("string"))), F.concat(F.lit("p"), c("part").cast("string"))))
    return line.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("rule_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"), F.array(name).alias("outputs"), made.alias("inputs"), F.create_map(name, c("l_linenumber") == 2).alias("temp"), (c("l_linenumber") % 4 != 3).alias("has_body"))


def _chained_files(spark, d):
    parts = load(spark, d, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("path"), (c("p_size") * 10).cast("bigint").alias("mtime"))
    line = load(spark, d, "lineitem").where("(l_orderkey + l_linenumber) % 3 <> 0").select(F.concat_ws("_", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("path"), (c("l_suppkey") * 5 + c("l_linenumber")).cast("bigint").alias("mtime"))
    return parts.union(line).groupBy("path").agg(F.min("mtime").alias("mtime")).select("path", F.lit(True).alias("exists"), "mtime")


def _coming(spark, d):
    return load(spark, d, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("path"), c("p_partkey").cast("string").alias("owner"))


def chain_staleness(spark, d):
    """Rules up to seven deep, some without a body, some inputs still to come from other jobs."""
    return graph.staleness(_chained(spark, d), _chained_files(spark, d), external=_coming(spark, d)).select("rule_id", "will_run", F.when(~c("will_run"), F.coalesce("eff", F.lit(-1))).otherwise(-2).alias("eff"))


_CHAIN = """ln as (select l_orderkey o, l_linenumber n, min(l_partkey) part, min(l_suppkey) s from lineitem group by 1, 2),
ch as (select *, lag(n) over (partition by o order by n) before, row_number() over (partition by o order by n) r, case when (o + n) % 3 <> 0 then s * 5 + n end f,
       case when part % 10 <> 0 then p_size * 10 end pt, part % 20 = 0 coming from ln join part on p_partkey = part),
st as (select o, n, r, f, (coming and pt is null) or (f is null and n <> 2) or coalesce(f < pt, false) run, coalesce(f, pt) eff from ch where r = 1
union all select ch.o, ch.n, ch.r, ch.f, st.run or (ch.coming and ch.pt is null) or (ch.f is null and ch.n <> 2) or coalesce(ch.f < greatest(ch.pt, st.eff), false), coalesce(ch.f, greatest(ch.pt, st.eff)) from st join ch on ch.o = st.o and ch.r = st.r + 1)"""


def chain_build(spark, d):
    """The jobs that are made, and what each waits for."""
    rules, files, coming = settled(_chained(spark, d), "rules"), settled(_chained_files(spark, d), "files"), _coming(spark, d)
    stale = graph.staleness(rules, files, external=coming)
    build = graph.to_build(rules, stale, files)
    waits = graph.dependencies(rules, build, stale, files, coming)
    return graph.jobs(rules, build).select("rule_id").join(shuffled(waits), "rule_id", "left").select("rule_id", F.coalesce("producer", F.lit(-1)).alias("producer"), F.coalesce("job_id", F.lit("")).alias("job_id"))


def chain_unmakeable(spark, d):
    return graph.unmakeable(_chained(spark, d), _chained_files(spark, d), _coming(spark, d))


def chain_satisfiable(spark, d):
    return graph.satisfiable(_chained(spark, d), _chained_files(spark, d).where("path like 'p%'"))


def default_goal(spark, d):
    """All that the first rule's output is made from, and what is named instead of it."""
    rules = _rules(spark, d).withColumn("ord", c("rule_id"))
    edges = graph.edges_of(rules)
    one = graph.reachable(edges, graph.goals(rules)).withColumn("how", F.lit("first"))
    two = graph.reachable(edges, graph.goals(rules, None, ["o1", "o2"])).withColumn("how", F.lit("default"))
    return one.union(two).union(graph.goals(rules, ["o7"], ["o1"]).withColumn("how", F.lit("named")))


def fan_out(spark, d):
    """A job for each part by name, but those up to date; and the numbers of those left, as ranges."""
    files = sheet.enumerated(load(spark, d, "part").select(F.concat_ws("/", F.lit("in"), c("p_partkey").cast("string"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".fq"))).alias("path"), "p_partkey", "p_size"), ["p_partkey"])
    disk = files.select("path", F.lit(True).alias("exists"), c("p_size").cast("bigint").alias("mtime")).union(files.where("p_partkey % 5 <> 0").select(strings.placeholders("out/{@.fq}.{#}.bam", c("path"), c("n")).alias("path"), F.lit(True), F.lit(20).cast("bigint")))
    jobs = sheet.fan_out(files.select("n", "path"), "run {} > {^.fq}.{#} {{}}", ["out/{@.fq}.{#}.bam"], [], disk)
    left = sheet.ranges(jobs.where("not skipped"), [], "n").select(F.sha2("spec", 256).alias("spec"))
    return jobs.crossJoin(F.broadcast(left)).select("n", "path", "command", lists.join(c("outs"), " ").alias("outs"), "skipped", "spec")


FAN_OUT = """with x as (select row_number() over (order by p_partkey) n, 'in/' || p_partkey || '/' || replace(p_name, ' ', '_') stem, replace(p_name, ' ', '_') base, p_size, p_partkey % 5 <> 0 and p_size <= 20 skipped from part),
r as (select n, n - row_number() over (order by n) g from x where not skipped), s as (select string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) spec from (select min(n) a, max(n) b from r group by g))
select n::bigint n, stem || '.fq' path, 'run ' || stem || '.fq > ' || stem || '.' || n || ' {}' command, 'out/' || base || '.' || n || '.bam' outs, skipped, sha256(spec) spec from x, s"""


def sparse_members(spark, d):
    """Of each array the members that still run, as ranges."""
    stale = graph.staleness(_chained(spark, d), _chained_files(spark, d), external=_coming(spark, d)).where("will_run")
    return sheet.ranges(stale.select(F.floor(c("rule_id") / 10).alias("l_orderkey"), (c("rule_id") % 10).alias("n")), ["l_orderkey"], "n")


def opportunistic(spark, d):
    return graph.ready(_rules(spark, d), _files(spark, d))


def up_to_date(spark, d):
    line = load(spark, d, "lineitem")
    outs = line.select(c("l_partkey").alias("key"), F.when(c("l_linenumber") < 7, seconds(c("l_shipdate"))).alias("mtime"))
    ins = line.join(load(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).select(c("l_partkey").alias("key"), (seconds(c("o_orderdate")) - 200000000).alias("mtime"))
    return graph.up_to_date(outs, ins)


def array_spec(spark, d):
    return sheet.ranges(load(spark, d, "orders"), ["o_custkey"], "o_orderkey")


def array_collapse(spark, d):
    line = load(spark, d, "lineitem").select(c("l_orderkey").alias("group"), c("l_linenumber").alias("index"), c("l_suppkey").alias("consumer"))
    return graph.collapsed(line, line.select("group", "index").distinct()).select("consumer", c("group").alias("grp"), "whole")


def array_elementwise(spark, d):
    line = load(spark, d, "lineitem").select(c("l_orderkey").alias("consumer_group"), c("l_linenumber").alias("consumer_index"), c("l_returnflag").alias("producer_group"), F.when(c("l_suppkey") % 11 == 0, 1).otherwise(c("l_linenumber")).alias("producer_index"))
    return graph.elementwise(line)


def dup_index(spark, d):
    return graph.duplicate_indexes(load(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", c("l_linenumber").cast("bigint").alias("l_linenumber"), "n")


def one_signature(spark, d):
    return graph.one_signature(load(spark, d, "part"), "p_name", "p_brand").withColumnRenamed("p_name", "name")


def enrich_lookup(spark, d):
    orders, cust, nat = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "nation")
    known = orders.join(cust.where("c_acctbal > 0"), c("o_custkey") == c("c_custkey"), "left").join(nat.where("n_regionkey < 3"), c("c_nationkey") == c("n_nationkey"), "left")
    return known.select("o_orderkey", F.coalesce("n_name", "c_mktsegment", F.lit("?")).alias("label"))


def reusable_owner(spark, d):
    log = _log(spark, d)
    outs = load(spark, d, "customer").select(c("c_custkey").alias("rule_id"), F.posexplode(F.transform(F.array(F.lit("view"), F.lit("click"), F.lit("error")), lambda k: F.concat_ws("/", k, c("c_custkey").cast("string")))).alias("pos", "path"))
    act = ledger.latest(log).where("task_index <> 0").select("job_id")
    return ledger.reusable(outs, ledger.owners(log), act)


def external_inputs(spark, d):
    log = _log(spark, d)
    ins = load(spark, d, "customer").select(F.concat(F.lit("click/"), c("c_custkey").cast("string")).alias("path"))
    files = load(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("click/"), c("c_custkey").cast("string")).alias("path"), F.lit(True).alias("exists"))
    return ledger.external(ins, files, ledger.owners(log), ledger.latest(log).where("task_index <> 0").select("job_id"))


def union_logs(spark, d):
    log = _log(spark, d)
    return log.where("name = 'click'").union(log.where("name = 'error'")).orderBy("submit_time", "job_id").select("job_id", "submit_time", F.row_number().over(W.partitionBy("user").orderBy("submit_time", "job_id")).cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (
    group_gather, group_lists, gather_all, scatter_index, running_total, last_value, ledger_latest, ledger_owner, ledger_vacuum, ledger_search, ledger_dump, ledger_roundtrip, ledger_compact, ledger_owner_of, log_names, status_normalise, status_words, details_told, details_accounted, job_report, job_modes, node_counts, status_reconcile, owner_report, aged_out,
    graph_sources, graph_nodes_edges, graph_reach, graph_layers, graph_places, graph_dot, wildcard_match, wildcard_rules, first_candidate, staleness, to_build, satisfiable, chain_staleness, chain_build, chain_unmakeable, chain_satisfiable, default_goal, fan_out, sparse_members, opportunistic, up_to_date, array_spec, array_collapse,
    array_elementwise, dup_index, one_signature, enrich_lookup, reusable_owner, external_inputs, union_logs)}

_LOG = "lg as (select event_id, ts, event_type, user_id::varchar usr, event_type || '/' || user_id path, event_id::varchar job_id, (epoch_us(ts) // 1000000)::bigint sub from events), ow as (select path, arg_max(job_id, (ts, event_id)) \"owner\" from lg group by 1)"
_RECURSE = f"with recursive {_EDGES}, t as (select src \"name\", 0 layer from edges where src not in (select dst from edges) union select dst, layer + 1 from t join edges on src = t.\"name\")"
SQL = {
    "group_gather": "select event_type, ((r - 1) // 1000)::bigint block, sha256(string_agg(event_id::varchar, ' ' order by event_id)) ids_sha256, count(*)::bigint n from (select event_type, event_id, row_number() over (partition by event_type order by event_id) r from events) group by 1, 2",
    "group_lists": "select n_regionkey::bigint n_regionkey, string_agg(n_name, ' ' order by n_nationkey) \"names\", min(n_nationkey)::bigint first_key from nation group by 1",
    "gather_all": "select ((r - 1) // 4096)::bigint block, sha256(string_agg(o_orderkey::varchar, ',' order by r)) keys_sha256, count(*)::bigint n from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) r from orders) group by 1",
    "scatter_index": "select s_suppkey, row_number() over (partition by s_nationkey, k order by s_suppkey)::bigint i, k::bigint k, 'out_' || s_name || '.' || kind path from supplier, (values (1, 'sum'), (2, 'log')) v(k, kind)",
    "running_total": "select o_orderkey, cents, sum(cents) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)::bigint total from (select *, round(o_totalprice * 100)::bigint cents from orders)",
    "last_value": "select user_id, arg_max(event_type, (ts, event_id)) last_type from events group by 1",
    "ledger_latest": f"with {_LOG} select usr user_name, job_id, event_type \"name\", sub submit_time from lg qualify row_number() over (partition by usr order by ts desc, event_id desc) = 1",
    "ledger_owner": f"with {_LOG} select * from ow",
    "ledger_roundtrip": f"with {_LOG} select * from ow",
    "ledger_compact": f"with {_LOG} select job_id, usr user_name, epoch_us(ts) * 1000 ts, event_id seq from lg where job_id in (select \"owner\" from ow)",
    "ledger_owner_of": f"with {_LOG} select * from ow where path = 'click/7'",
    "log_names": "select n_nationkey, 'node-' || n_nationkey || '-x' host, (n_nationkey * 31)::varchar pid, n_regionkey::varchar nth from nation",
    "status_words": STATUS_WORDS, "details_told": DETAILS_TOLD, "details_accounted": DETAILS_ACCOUNTED,
    "job_report": f"""with {_LOG}, dn as (select "owner" job_id, bool_and(path like 'click/%' and c_custkey is not null) ok from ow left join customer on split_part(path, '/', 2) = c_custkey::varchar group by 1),
x as (select *, event_id % 7 ti, event_id % 7 < 3 told, event_id % 10 = 0 arr, case when event_id % 7 < 3 then 'running' when coalesce(ok, false) then 'done' else 'unknown' end state from lg left join dn using (job_id))
select job_id, state, case when told then 0 else -1 end::bigint exit_code, case when told and ti <> 1 then '2020-01-02T03:04:05Z' else strftime(make_timestamp(sub * 1000000), '%Y-%m-%dT%H:%M:%SZ') end submit_time, case when told then 'root' else usr end user_name, '/w' work_dir,
case when told then 'Priority' else '' end reason, job_id || chr(9) || state || chr(9) || event_type || case when told then chr(9) || 'Priority' else '' end line, case when arr then ti else -1 end::bigint task from x""",
    "job_modes": "select o_orderkey job_id, case when o_orderstatus <> 'O' then o_orderpriority else 'UNKNOWN' end native_state from orders",
    "node_counts": "select case when o_orderkey % 4 <> 0 then 'Done' when o_orderkey % 3 = 0 and o_orderkey % 9 <> 0 then o_orderpriority else 'Pending' end state, count(*)::bigint n from orders group by 1",
    "chain_staleness": f"with recursive {_CHAIN} select o * 10 + n rule_id, run will_run, case when not run then coalesce(eff, -1) else -2 end::bigint eff from st",
    "chain_build": f"""with recursive {_CHAIN}, x as (select st.*, ch.before, ch.part, ch.pt, ch.coming, b.run brun, b.f bf, b.n bn from st join ch on ch.o = st.o and ch.n = st.n left join st b on b.o = st.o and b.n = ch.before),
bu as (select o, n from st where run union select x.o, x.bn from x join bu on x.o = bu.o and x.n = bu.n where x.bn is not null and x.bf is null),
jb as (select x.* from x join (select distinct o, n from bu) using (o, n) where n % 4 <> 3),
ed as (select o * 10 + n rule_id, o * 10 + bn producer, null::varchar job_id from jb where bn is not null and bn % 4 <> 3 and (brun or bf is null) union all select o * 10 + n, null, part::varchar from jb where pt is null and coming)
select jb.o * 10 + jb.n rule_id, coalesce(producer, -1)::bigint producer, coalesce(job_id, '') job_id from jb left join ed on ed.rule_id = jb.o * 10 + jb.n""",
    "chain_unmakeable": f"with recursive {_CHAIN} select o * 10 + n rule_id, 'p' || part path from ch where pt is null and not coming",
    "chain_satisfiable": f"with recursive {_CHAIN}, sa as (select o, r from ch where r = 1 and pt is not null union all select ch.o, ch.r from sa join ch on ch.o = sa.o and ch.r = sa.r + 1 where ch.pt is not null) select ch.o * 10 + ch.n rule_id from sa join ch using (o, r)",
    "default_goal": """with a as (select max(c_custkey) k from customer), one as (select 'c' || c_custkey x, 'n' || c_nationkey y from customer, a where c_custkey = k),
two as (select 'o' || o_orderkey x, 'c' || o_custkey y, 'n' || c_nationkey z from orders join customer on o_custkey = c_custkey where o_orderkey in (1, 2))
select x "name", 'first' how from one union select y, 'first' from one union select x, 'default' from two union select 'o' || v, 'default' from (values (1), (2)) t(v) union select y, 'default' from two union select z, 'default' from two union select 'o7', 'named'""",
    "fan_out": FAN_OUT,
    "sparse_members": f"""with recursive {_CHAIN}, q as (select o, n, n - row_number() over (partition by o order by n) g from st where run)
select o l_orderkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) spec from (select o, g, min(n) a, max(n) b from q group by o, g) group by o""",
    "ledger_vacuum": f"with {_LOG} select job_id, usr user_name, epoch_us(ts) * 1000 ts, event_id seq from lg where job_id in (select \"owner\" from ow)",
    "ledger_search": f"with {_LOG} select job_id, 'filters' how from lg where contains(event_type, 'ic') and contains(path, '/1') and event_id % 2 = 0 union all select job_id, 'array' from lg where event_id % 10 = 0 and event_id // 100 = 3 union all select job_id, 'id' from lg where job_id = '17'",
    "ledger_dump": f"""with {_LOG} select job_id, k "key", v "value", p::bigint pos from (
select job_id, unnest(['PIPELINE', 'WORKINGDIR', 'RUNID', 'NAME', 'USER', 'SUBMIT', case when event_type = 'click' then 'TEMP' else 'OUTPUT' end, 'INPUT', 'SETTING']) k, unnest(['p', '/w', 'r', event_type, usr, sub::varchar, path, path || '.in', 'mem' || chr(9) || '8G']) v, 0 p from lg
union all select job_id, unnest(['ARRAY', 'TASKINDEX']), unnest(['arr' || (event_id // 100), (event_id % 7)::varchar]), 0 from lg where event_id % 10 = 0
union all select job_id, 'SRC', unnest(['echo ' || event_type, '', 'done']), unnest([0, 1, 2]) from lg where event_id % 2 = 0)""",
    "status_normalise": STATUS_NORMALISE, "status_reconcile": STATUS_RECONCILE,
    "owner_report": f"with {_LOG} select \"owner\" job_id, sub submit_time, string_agg(ow.path, ' ' order by ow.path) paths from ow join lg on job_id = \"owner\" group by 1, 2",
    "aged_out": f"with {_LOG} select \"owner\", bool_and(coalesce(path like 'click/%' and c_custkey is not null, false)) complete from ow left join customer on split_part(path, '/', 2) = c_custkey::varchar group by 1",
    "graph_sources": f"with {_EDGES} select distinct src \"name\" from edges where src not in (select dst from edges)",
    "graph_nodes_edges": f"with {_EDGES} select left(x, 1) kind, count(*)::bigint n from (select src x from edges union select dst from edges) group by 1 union all select 'edges', count(*)::bigint from edges",
    "graph_reach": f"with recursive {_EDGES}, g as (select 'l' || l_orderkey || '_' || l_linenumber x from lineitem order by l_orderkey desc, l_linenumber desc limit 1), t as (select x from g union select src from t join edges on dst = x) select x \"name\" from t",
    "graph_layers": _RECURSE + " select \"name\", max(layer)::bigint layer from t group by 1",
    "graph_places": _RECURSE + ", m as (select \"name\", max(layer)::bigint layer from t group by 1) select \"name\", layer, row_number() over (partition by layer order by \"name\")::bigint place from m",
    "graph_dot": """select 'digraph {' line, 0::bigint ord union all select '}', 3 union all select '  "' || n_name || '";', 1 from nation union all select distinct '  "' || n_regionkey || '" [shape=note];', 1 from nation
union all select '  "' || n_regionkey || '" -> "' || n_name || '";', 2 from nation""",
    "wildcard_match": "select rule_id::bigint rule_id, p_name path, substr(p_name, length(a) + 1, length(p_name) - length(a) - length(b)) stem from (select distinct p_name from part), (values (1, 'small ', ''), (2, '', ' ring'), (3, '', 'l%'), (4, 'b', 'e')) r(rule_id, a, b) where starts_with(p_name, a) and ends_with(p_name, b) and length(p_name) > length(a) + length(b)",
    "wildcard_rules": "select distinct s stem, s || '.bam ' || s || '.log' made, s || '.fq ref.fa' needed from (select replace(p_name, ' ', '_') s from part)",
    "first_candidate": "select l_partkey path, l_suppkey rule_id, s_acctbal > 5000 ok from (select distinct l_partkey, l_suppkey from lineitem) join supplier on l_suppkey = s_suppkey qualify row_number() over (partition by l_partkey order by s_acctbal > 5000 desc, l_suppkey % 7 = 0, l_suppkey) = 1",
    "staleness": f"with {_STALE} select o_orderkey rule_id, run will_run, coalesce(eff, -1)::bigint eff from os union all select -c_custkey - 1, run, coalesce(eff, -1)::bigint from cs",
    "to_build": f"with {_STALE} select o_orderkey rule_id from os where run union select -c_custkey - 1 from cs where run union select -o_custkey - 1 from os join cs on o_custkey = c_custkey where os.run and cs.f is null",
    "satisfiable": f"with {_STALE} select -c_custkey - 1 rule_id from cs where newest is not null union all select o_orderkey from os join cs on o_custkey = c_custkey where cs.f is not null or cs.newest is not null",
    "opportunistic": f"with {_STALE} select -c_custkey - 1 rule_id from cs where newest is not null union all select o_orderkey from os join cs on o_custkey = c_custkey where cs.f is not null",
    "up_to_date": "select l_partkey \"key\", bool_and(l_linenumber < 7) and min(case when l_linenumber < 7 then epoch(l_shipdate) end) >= max(epoch(o_orderdate)) - 200000000 ok from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "array_spec": """select o_custkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) spec from (select o_custkey, min(n) a, max(n) b from (select o_custkey, n, n - row_number() over (partition by o_custkey order by n) g from (select distinct o_custkey, o_orderkey n from orders)) group by o_custkey, g) group by 1""",
    "array_collapse": "select l_suppkey consumer, l_orderkey grp, count(distinct l_linenumber) = any_value(n) whole from lineitem join (select l_orderkey, count(distinct l_linenumber) n from lineitem group by 1) using (l_orderkey) group by 1, 2",
    "array_elementwise": "select l_orderkey consumer_group, l_returnflag producer_group, bool_and(c = 1 and p = l_linenumber) co from (select l_orderkey, l_returnflag, l_linenumber, count(distinct x) c, min(x) p from (select *, case when l_suppkey % 11 = 0 then 1 else l_linenumber end x from lineitem) group by 1, 2, 3) group by 1, 2",
    "dup_index": "select l_orderkey, l_linenumber::bigint l_linenumber, count(*)::bigint n from lineitem group by 1, 2 having count(*) > 1",
    "one_signature": "select p_name \"name\", count(distinct p_brand) = 1 ok from part group by 1",
    "enrich_lookup": "select o_orderkey, coalesce(n_name, c_mktsegment, '?') \"label\" from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey",
    "reusable_owner": f"with {_LOG} select c_custkey rule_id, arg_min(\"owner\", pos) job_id from customer, (values (0, 'view'), (1, 'click'), (2, 'error')) v(pos, k), ow where ow.path = k || '/' || c_custkey and \"owner\"::bigint % 7 <> 0 group by 1",
    "external_inputs": f"with {_LOG} select path, \"owner\" from ow join customer on path = 'click/' || c_custkey where c_custkey % 2 = 1 and \"owner\"::bigint % 7 <> 0",
    "union_logs": f"with {_LOG} select job_id, sub submit_time, row_number() over (partition by usr order by sub, job_id)::bigint n from lg where event_type in ('click', 'error')",
}
