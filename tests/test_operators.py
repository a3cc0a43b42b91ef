"""Cases that the driver's tables do not have: readers, ledger folds, graphs, states, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import lists, strings, values
from tessera.operators import graph, ledger, sheet, status
from tessera.plans import relational_queries
from tessera.sources import folders, sheets
from tessera.streaming import ledger_stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


SHEET = "plate\twell\tvolume\tnote\n#  not yet\n7\tA1\t2.5\tfirst\n\n7\tB12\t4\t\n8\tC3\t1\tlast\textra\n9\tD4\n"


def test_tsv(spark, tmp_path):
    df = sheets.read_tsv(spark, write(tmp_path, "a.tsv", SHEET))
    assert [tuple(r) for r in df.orderBy("well").collect()] == [(7, "A1", "2.5", "first"), (7, "B12", "4", ""), (8, "C3", "1", "last"), (9, "D4", "", "")]
    assert dict(df.dtypes) == {"plate": "bigint", "well": "string", "volume": "string", "note": "string"}  # an empty cell keeps a text
    assert [r.plate for r in sheets.read_tsv(spark, write(tmp_path, "b.tsv", "plate\n007\n"), raw=True).collect()] == ["007"]
    assert sheets.read_tsv(spark, write(tmp_path, "c.tsv", "key\tkey\tv\nold\tnew\t1.5\n")).collect() == [("new", 1.5)]
    assert sheets.read_tsv(spark, write(tmp_path, "d.tsv", "; half\nk;v\na;true\nb;false\n"), sep=";", comment="").count() == 3
    for bad in ({"sep": "ab"}, {"sep": ""}):
        with pytest.raises(ValueError):
            sheets.read_tsv(spark, "x", **bad)
    with pytest.raises(TypeError):
        sheets.read_tsv(spark, "x", quote="'")


def test_tsv_skip(spark, tmp_path):
    """Columns come from the header, not from the lines before it, and every record keeps them."""
    path = write(tmp_path, "s.tsv", "made by a robot\n# day 3\nbatch\tno\nplate\twell\tvolume\n1\tA1\t3\n2\tB2\t4\n")
    assert [tuple(r) for r in sheets.read_tsv(spark, path, skip=2).orderBy("plate").collect()] == [(1, "A1", 3), (2, "B2", 4)]
    bare = sheets.read_tsv(spark, path, skip=3, header=False)
    assert bare.columns == ["c0", "c1", "c2"] and bare.count() == 2
    assert sheets.read_tsv(spark, write(tmp_path, "t.tsv", "x\ny\tz\n1\t2\t3\n"), header=False).columns == ["c0", "c1", "c2"]
    assert sheets.read_tsv(spark, write(tmp_path, "u.tsv", 'x\n"y\tz"\n'), header=False).columns == ["c0"]


def test_many_files(spark, tmp_path):
    """Each part file's header goes, whatever the parts' number, and so do empty files."""
    own = spark.range(1000).selectExpr("id", "concat('w', id) as word", "if(id % 100 = 0, 'two\nlines', 'one') as cell")
    for sep in (",", "\t"):
        path = str(tmp_path / f"many{ord(sep)}")
        sheets.write_delimited(own.repartition(7), path, sep)
        sheets.write_delimited(own.limit(0), path, sep, append=True)
        back = sheets.read_delimited(spark, path, sep)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.collect()))
    assert sheets.read_csv(spark, write(tmp_path, "none.csv", "")).count() == 0
    assert sheets.read_csv(spark, write(tmp_path, "head.csv", "a,b\n")).columns == ["a", "b"]


def test_other_readers(spark, tmp_path):
    df = sheets.read_json(spark, write(tmp_path, "a.json", '[{"tag":"u","size":4.0,"more":{"x":[1]}},{"tag":null,"size":9}]'))
    assert df.columns == ["more", "size", "tag"] and [(r["size"], r.tag, r.more) for r in df.collect()] == [(4, "u", '{"x":[1]}'), (9, "", "")]
    with pytest.raises(ValueError):
        sheets.read_json(spark, write(tmp_path, "b.json", '{"tag":"u"}'))
    path = write(tmp_path, "a.txt", "head\nalpha\r\n  # beta\n\ngamma\n")
    assert [r.value for r in sheets.read_lines(spark, path, comment="#", skip=1).collect()] == ["alpha", "", "gamma"]
    assert sheets.read_lines(spark, path, blank=False).count() == 4
    assert sheets.read_paths(spark, path).count() == 4 and sheets.read_text(spark, path).first().value.startswith("head\nalpha")
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "x", "1")
    files = sheets.read_files(spark, str(tmp_path))
    paths = spark.createDataFrame([(f"{tmp_path}/in",), (f"{tmp_path}/in/x",), (f"{tmp_path}/out",)], "path string")
    assert sorted(tuple(r)[1:] for r in sheets.file_kinds(paths, files).collect()) == [(False, False, False), (True, False, True), (True, True, False)]


def test_texts(spark):
    assert one(spark, strings.basename(F.lit("a/b/"))) == "b" and one(spark, strings.basename(F.lit(""))) == "." and one(spark, strings.basename(F.lit("//"))) == "/"
    assert one(spark, strings.dirname(F.lit("a/b/../c"))) == "a" and one(spark, strings.dirname(F.lit("x"))) == "." and one(spark, strings.abspath(F.lit("../x"), "/a/b")) == "/a/x"
    for x, want in ((3.0, "3"), (1e6, "1e+06"), (0.5, "0.5"), (-1234567.5, "-1.2345675e+06"), (1e-5, "1e-05"), (0.0, "0"), (1e100, "1e+100"), (123456.0, "123456"), (0.00012, "0.00012")):
        assert one(spark, values.float_text(F.lit(x))) == want
    assert one(spark, strings.char_at(F.lit("aé"), 1)) == "é"
    assert one(spark, strings.elide(F.lit("éé"), 4)) == "éé" and one(spark, strings.elide(F.lit("ééé"), 5)) == "éé…"
    with pytest.raises(ValueError):
        strings.sub(F.lit("a"), "(?=a)", "b")
    assert one(spark, lists.cut(F.array(F.lit(1), F.lit(2), F.lit(3)), -2)) == [2, 3]


def rec(ts, job, outputs, host="h", **more):
    return {"ts": ts, "seq": 1, "host": host, "pid": 1, "job_id": job, "name": f"n{job}", "submit_time": ts, "outputs": outputs} | more


def test_ledger(spark, tmp_path):
    path = tmp_path / "h-1-2-3.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in (rec(200, "200", ["out.bam"]), rec(100, "100", ["out.bam"]), rec(150, "300", ["other.bam"], array_id="arr"))) + '\n{"ts": 1, "job')
    df = ledger.read(spark, str(tmp_path))
    assert df.count() == 3
    assert {r.path: r.owner for r in ledger.owners(df).collect()} == {"out.bam": "200", "other.bam": "300"}
    assert sorted(r.job_id for r in ledger.vacuum(df).collect()) == ["200", "300"]
    assert [r.job_id for r in ledger.search(ledger.latest(df), id_="arr").collect()] == ["300"]
    facts = [(r.key, r.value) for r in ledger.dump(ledger.latest(df).where("job_id = '300'")).orderBy("k_ord", "pos").collect()]
    assert facts == [("NAME", "n300"), ("ARRAY", "arr"), ("TASKINDEX", "0"), ("SUBMIT", "150"), ("OUTPUT", "other.bam")]
    query = ledger_stream.owners(ledger_stream.records(spark, str(tmp_path))).writeStream.format("memory").queryName("owners_now").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.path: r.owner for r in spark.table("owners_now").collect()} == {"out.bam": "200", "other.bam": "300"}


RULES = "rule_id long, outputs array<string>, inputs array<string>, temp map<string,boolean>, has_body boolean"


@pytest.mark.parametrize(("files", "built"), [({"a": 9, "c": 0}, {1, 2}), ({"a": 0, "c": 9}, set()), ({"a": 0, "b": 29, "c": 20}, {2})])
def test_staleness(spark, files, built):
    rules = spark.createDataFrame([(1, ["b"], ["a"], {"b": True}, True), (2, ["c"], ["b"], {}, True)], RULES)
    disk = spark.createDataFrame([(k, True, v) for k, v in files.items()], "path string, exists boolean, mtime long")
    stale = graph.staleness(rules, disk)
    assert {r.rule_id for r in graph.to_build(rules, stale, disk).collect()} == built


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    with pytest.raises(ValueError):
        graph.layers(edges)
    rules = spark.createDataFrame([(1, ["b"], ["c"], {}, True), (2, ["c"], ["b"], {}, True), (3, ["d"], ["a"], {}, True)], RULES)
    assert [r.rule_id for r in graph.satisfiable(rules, spark.createDataFrame([("a",)], "path string")).collect()] == [3]
    with pytest.raises(ValueError):
        graph.staleness(rules, spark.createDataFrame([("a", True, 1)], "path string, exists boolean, mtime long"))


@pytest.mark.parametrize(("state", "word", "end", "mtime", "want"), [
    ("queued", "WAITING", None, 5_000, "WAITING"), ("failed", "TIMEOUT", 1_100, 1_050, "TIMEOUT"), ("cancelled", "CANCELLED", None, None, "CANCELLED"), ("done", "OK", None, 1_000, "OK"), ("done", "OK", None, 999, "DIRTY"),
    ("done", "OK", 1_500, 1_800, "OK"), ("done", "OK", 1_500, 1_801, "DIRTY"), ("done", "OK", 1_500, None, "DIRTY"), ("unknown", "", 1_500, 9_999, "COMPLETE"), ("unknown", "", None, 998, "DIRTY")])
def test_reconcile(spark, state, word, end, mtime, want):
    """A job submitted at 1000 with one output: the word counts up to 300 seconds after the end, and not before submission."""
    assert one(spark, status.reconcile(F.lit(word), F.lit(state), F.lit(1_000), F.lit(end).cast("long"), F.lit(mtime).cast("long"))) == want


def test_node_states(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    files = spark.createDataFrame([("a", True, 1)], "path string, exists boolean, mtime long")
    got = status.node_states(nodes, files, spark.createDataFrame([("b", "7")], "path string, owner string"), spark.createDataFrame([("7", "running")], "job_id string, state string"))
    assert {r.name: r.state for r in got.collect()} == {"a": "Done", "b": "running", "c": "Pending"}
    assert {r.state: r.n for r in status.counts(got).collect()} == {"Done": 1, "running": 1, "Pending": 1}


def test_compact(spark, tmp_path):
    """Broken lines, other writers' logs and records appended in between; a compacted folder reads the same."""
    folder = tmp_path / "led"
    folder.mkdir()
    (folder / "h-1-2-3.jsonl").write_text("\n".join(json.dumps(r) for r in (rec(200, "200", ["out.bam"]), rec(100, "100", ["out.bam"]))) + '\n{"ts": 9, "jo')
    ledger.compact(spark, str(folder))
    assert [r.job_id for r in ledger.read(spark, str(folder)).collect()] == ["200"] and not (folder / "h-1-2-3.jsonl").exists()
    ledger.append(spark.createDataFrame([json.dumps(rec(300, "300", ["out.bam", "b"])), json.dumps(rec(50, "50", ["c"]))], "string").select(F.from_json("value", ledger.SCHEMA).alias("r")).select("r.*"), str(folder))
    assert ledger.read(spark, str(folder)).count() == 3
    ledger.compact(spark, str(folder))
    ledger.compact(spark, str(folder))
    left = ledger.read(spark, str(folder), snapshot=True)
    assert sorted((r.job_id, tuple(r.outputs)) for r in left.collect()) == [("300", ("out.bam", "b")), ("50", ("c",))]
    assert ledger.read(spark, str(tmp_path / "absent")).count() == 0
    ledger.compact(spark, str(tmp_path / "absent"))
    with pytest.raises(NotADirectoryError):
        ledger.read(spark, write(tmp_path, "plain.jsonl", "{}"))


def test_deep_graph(spark):
    """As deep as it is long: no number of rounds is fixed."""
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    assert {r.name: r.layer for r in graph.layers(edges).collect()} == {f"n{i}": i for i in range(13)}
    assert graph.reachable(edges, spark.createDataFrame([("n12",)], "name string")).count() == 13


def test_rows_not_files_are_broadcast(spark, monkeypatch):
    """Numbers in order take few bytes of a file and many of the driver's memory: what has many rows is not broadcast."""
    n = 50_000
    monkeypatch.setattr(graph, "JOIN_BYTES", 1 << 16, raising=False)

    def name(kind):
        return F.concat(F.lit(kind), F.col("id").cast("string"))

    def rule(shift, out, made_of, temp):
        return spark.range(n).select((F.col("id") + shift).alias("rule_id"), F.array(name(out)).alias("outputs"), F.array(name(made_of)).alias("inputs"), F.create_map(name(out), temp).alias("temp"), F.lit(True).alias("has_body"))

    rules = rule(0, "b", "a", F.col("id") % 2 == 1).union(rule(n, "c", "b", F.lit(False)))
    files = spark.range(n).select(name("a").alias("path"), F.lit(True).alias("exists"), F.lit(5).cast("long").alias("mtime")).union(spark.range(n).where("id % 4 = 1").select(name("c"), F.lit(True), F.lit(9).cast("long")))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2500000")  # some 25,000 numbers
    try:
        built = graph.to_build(rules, graph.staleness(rules, files), files)
        assert sorted(r.rule_id for r in built.collect()) == [k for k in range(2 * n) if k % n % 4 != 1]
        assert sorted(r.rule_id for r in graph.satisfiable(rules, files.where("path like 'a%'")).collect()) == list(range(2 * n))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize(("limit", "rows", "join"), [(1 << 20, None, "BroadcastHashJoin"), (1 << 13, None, "SortMergeJoin"), (1 << 13, 9, "BroadcastHashJoin"), (1 << 20, 1 << 20, "SortMergeJoin")])
def test_small(spark, capsys, limit, rows, join):
    """What is not small is joined by shuffling, however small Spark takes it for."""
    spark.range(10_000).join(folders.small(folders.settled(spark.range(1_000), "some"), limit, **({"rows": rows} if rows else {})), "id").explain()
    assert join in capsys.readouterr().out


def test_dependencies(spark):
    """A rule without a body is no job: what needs it runs if it would, but waits for nothing of it."""
    rules = spark.createDataFrame([(1, ["a"], ["src"], {}, True), (2, ["all"], ["a"], {}, False), (3, ["z"], ["all", "far"], {}, True)], RULES).withColumn("ord", F.col("rule_id"))
    files = spark.createDataFrame([("src", True, 5), ("a", True, 1), ("z", True, 9)], "path string, exists boolean, mtime long")
    far = spark.createDataFrame([("far", "77")], "path string, owner string")
    stale = graph.staleness(rules, files, external=far)
    build = graph.to_build(rules, stale, files)
    assert {r.rule_id for r in build.collect()} == {1, 2, 3} and {r.rule_id for r in graph.jobs(rules, build).collect()} == {1, 3}
    assert {tuple(r) for r in graph.dependencies(rules, build, stale, files, far).collect()} == {(3, None, "77")}
    assert [tuple(r) for r in graph.unmakeable(rules, files).collect()] == [(3, "far")] and graph.unmakeable(rules, files, far).count() == 0
    assert [r.name for r in graph.goals(rules).collect()] == ["a"] and [r.name for r in graph.goals(rules, ["q"], ["z"]).collect()] == ["q"]
    with pytest.raises(ValueError):
        graph.goals(rules.limit(0))


def test_fan_out(spark):
    files = spark.createDataFrame([(1, "d/a.fq"), (2, "d/b.fq"), (3, "d/c.fq")], "n long, path string")
    disk = spark.createDataFrame([("d/a.fq", True, 5), ("d/b.fq", True, 5), ("b.bam", True, 5), ("d/c.fq", True, 5), ("c.bam", True, 4)], "path string, exists boolean, mtime long")
    got = sheet.fan_out(files, "x {@} {#}", ["{@.fq}.bam"], ["{^}.idx"], disk).orderBy("n").collect()
    assert [(r.command, r.outs, r.ins, r.skipped) for r in got] == [("x a.fq 1", ["a.bam"], ["d/a.fq", "d/a.fq.idx"], False), ("x b.fq 2", ["b.bam"], ["d/b.fq", "d/b.fq.idx"], True), ("x c.fq 3", ["c.bam"], ["d/c.fq", "d/c.fq.idx"], False)]
    assert not sheet.fan_out(files, "x", [], [], disk).where("skipped").count()


def test_blocks(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(100)], "g string, n int").repartition(5)
    got = {(r.g, r.block): r["items"] for r in sheet.gather_blocks(df, ["g"], "n", ["n"], 10).collect()}
    want = {}
    for g, own in (("a", [i for i in range(100) if i % 3]), (None, [i for i in range(100) if not i % 3])):
        want |= {(g, b): own[b * 10 : b * 10 + 10] for b in range((len(own) + 9) // 10)}
    assert got == want and sheet.gather_blocks(df.limit(0), ["g"], "n", ["n"]).count() == 0
    assert [r.n for r in sheet.enumerated(df, ["n"], "at").orderBy("at").select("n").collect()] == list(range(100))


def test_ranges(spark):
    df = spark.createDataFrame([("g", n) for n in (5, 1, 2, 3, 8, 7, 3)], "g string, n int")
    assert sheet.ranges(df, ["g"], "n").first().spec == "1-3,5,7-8"
    assert one(spark, status.probe_time(F.lit("Fri Jan  2 03:04:05 1970"))) == 97445


def test_ranges_of_all(spark, monkeypatch):
    """Without a key, all numbers are one text, whatever blocks it is joined from; its hash is drawn once, not for every row."""
    monkeypatch.setattr(sheet, "RANGE_BLOCK", 7)
    numbers = [n for n in range(-20, 200) if n % 5 and not 60 < n < 90]
    runs = [(n, next(m for m in range(n, 300) if m + 1 not in numbers)) for n in numbers if n - 1 not in numbers]
    df = spark.createDataFrame([(n,) for n in [*numbers, *numbers[:9]]], "n int").repartition(5)
    assert [r.spec for r in sheet.ranges(df, [], "n").collect()] == [",".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)]
    assert [r.spec for r in sheet.ranges(df.limit(0), [], "n").collect()] == [None]
    plan = relational_queries.fan_out(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "sha2" not in plan.splitlines()[0]


def test_links_shrink(spark):
    """Edges that are used are not read again once they are half of all; nodes wait for all of theirs, whatever the round."""
    links = graph.Links(spark.createDataFrame([(i, 10 * i) for i in range(8)], "src long, dst long"))
    for used in ([0, 1, 2, 3, 4], [5, 6], [7]):
        got = links.of(spark.createDataFrame([(i,) for i in used], "src long"))
        assert sorted(r.dst for r in got.collect()) == [10 * i for i in used]
        links.left -= len(used)
    assert links.left == 0 and sorted(r.src for r in links._held.collect()) == [7]
    needs = {1: [], 2: [1], 3: [2], 4: [1, 3], 5: [4, 1, 2], 6: [5, 3]}
    rules = spark.createDataFrame([(i, [f"f{i}"], [f"f{x}" for x in own] + ["src"], {}, True) for i, own in needs.items()], RULES)
    files = spark.createDataFrame([("src", True, 5), *((f"f{i}", True, 9 if i != 2 else 4) for i in needs)], "path string, exists boolean, mtime long")
    stale = graph.staleness(rules, files)
    assert {r.rule_id: r.will_run for r in stale.collect()} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_several_makers(spark):
    """A path that two rules make is met by the first of them, once; a null input never is, no inputs always are."""
    rules = spark.createDataFrame([(1, ["x"], ["a"]), (2, ["x", "y"], ["y0"]), (3, ["y0"], ["x"]), (4, ["z"], ["x", "y"]), (5, ["w"], ["x", "none"]), (6, ["v"], [None]), (7, [], []), (8, ["u"], ["z", "x"])], "rule_id long, outputs array<string>, inputs array<string>")
    got = graph.satisfiable(rules, spark.createDataFrame([("a",), ("a",)], "path string"))
    assert sorted(r.rule_id for r in got.collect()) == [1, 2, 3, 4, 7, 8]


def written(spark, monkeypatch, *modules):
    """Names of the tables that these modules settle, as they do."""
    names = []
    for module in modules:
        monkeypatch.setattr(module, "settled", lambda df, name, own=module.settled: (names.append(name), own(df, name))[1])
    return names


def test_places_once(spark, monkeypatch):
    """Numbering within keys writes the rows once; what else it writes is a row a key, sent to them if it is small."""
    names = written(spark, monkeypatch, sheet)
    own = sheet.enumerated_within(spark.range(1000).selectExpr("id % 3 as k", "id as v"), ["k"], ["v"], "at")
    assert {(r.k, r.v): r["at"] for r in own.collect()} == {(v % 3, v): v // 3 + 1 for v in range(1000)}
    assert names == ["enumerated", "first"] and "BroadcastHashJoin" in own._jdf.queryExecution().executedPlan().toString()


def test_layers_rounds(spark, monkeypatch):
    """As many rounds as layers have edges from them: none to find that the last has none."""
    names = written(spark, monkeypatch, graph)
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert {r.name: r.layer for r in graph.layers(edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert names.count("found") == 3


def test_compact_parses_once(spark, tmp_path, monkeypatch):
    """Lines are parsed once for owners and for last records, so both see the same records; a job's last record stays, not the owning one."""
    folder = tmp_path / "once"
    folder.mkdir()
    (folder / "h-1-2-3.jsonl").write_text("\n".join(json.dumps(r) for r in (rec(1, "a", ["x"]), rec(2, "a", ["y"]), rec(3, "b", ["y"]), rec(4, "c", ["y"], submit_time="soon"))))
    names = written(spark, monkeypatch, ledger)
    ledger.compact(spark, str(folder))
    assert names == ["compact"] and sorted((r.job_id, r.ts) for r in ledger.read(spark, str(folder)).collect()) == [("a", 2), ("b", 3)]


def test_staleness_moves(spark):
    """What a rule and its edges shuffle where nothing is small enough to be broadcast: edges once a round only while they are left."""
    n = 20_000
    rules = spark.range(n, numPartitions=4).selectExpr("id as rule_id", "array(concat('x', id)) as outputs", "if(id % 7 = 0, array(concat('s', id)), array(concat('x', id - 1), concat('s', id))) as inputs", "map(concat('x', id), false) as temp")
    files = spark.range(n, numPartitions=4).selectExpr("concat('s', id) as path", "true as exists", "5L as mtime").union(spark.range(n, numPartitions=4).selectExpr("concat('x', id)", "true", "if(id % 70 = 3, 4L, 9L)"))

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = shuffled()
        stale = graph.staleness(rules, files)
        moved = (shuffled() - began) / n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r.rule_id for r in stale.where("will_run").collect()} == {i for i in range(n) if 3 <= i % 70 < 7}
    assert moved < 135, moved


def test_ranges_shuffle_once(spark):
    """Numbers of a key come together once, repeated ones and all."""
    got = sheet.ranges(spark.range(40).selectExpr("id % 2 as k", "id div 4 as n").where("n <> 4"), ["k"], "n")
    assert {r.k: r.spec for r in got.collect()} == {0: "0-3,5-9", 1: "0-3,5-9"}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_odd_outputs(spark):
    """An output without a path is missing, one made twice is waited for twice; a rule without outputs is none, without inputs waits for nothing."""
    rules = spark.createDataFrame([(1, [None], ["s"], {}, True), (2, ["x"], ["s"], {}, True), (3, ["x"], [], {}, True), (4, ["y"], ["x", "x", None], {}, True), (5, [], ["s"], {}, True), (6, None, None, {}, True), (7, ["z"], None, {"z": True}, True)], RULES)
    files = spark.createDataFrame([("s", True, 5), ("x", True, 7), ("y", True, 6), ("z", False, 1)], "path string, exists boolean, mtime long")
    got = {r.rule_id: (r.will_run, r.eff) for r in graph.staleness(rules, files).collect()}
    assert got == {1: (True, 5), 2: (False, 7), 3: (False, 7), 4: (True, 6), 7: (False, None)}
