"""Dependency graphs of rules and files: candidates, reachability, layers, staleness, arrays.

``rules`` has ``rule_id, ord, outputs, inputs`` (arrays), ``temp`` (map of
output to boolean) and ``has_body``; ``files`` has ``path, exists, mtime``;
edges run ``src`` to ``dst``.  Fixpoints run some Spark jobs a layer, over what
the last layer has settled and what depends on it alone; each layer is added to
a table in the shared folder, so lineage does not grow.  They end when a layer
is empty or every edge is used, however deep the graph.  What a join may
broadcast is measured by its rows, so the driver holds ``JOIN_BYTES`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.folders import JOIN_BYTES, Pile, settled, shuffled, small


#: Edges that are not worth a table of their own if one round may use them all.
FEW = 1000


class Links:
    """Edges by ``src``, each used in the one round in which its ``src`` is settled.

    Once the edges used since the last time and the newly settled ``src`` come to an
    eighth of those held, the join that finds the round's edges writes them and those
    left anew, and later rounds read what is left: nothing is shuffled for that alone,
    and all that is so written is at most eight times the edges and nodes.
    """

    def __init__(self, edges: DataFrame):
        self._held, self._spent, self._rows = edges, None, 0
        self.left = self._size = edges.count()

    def of(self, front: DataFrame) -> DataFrame:
        """The edges of the newly settled ``src`` with the other columns of ``front`` (settled)."""
        if self._size is None:
            self._size = self.left
        n, used = front.count(), self._size - self.left
        if 8 * (used + n) >= self._size and (used or n < self.left or self.left > FEW):
            known = front.withColumn("_new", F.lit(True))
            if self._spent is not None:
                known = known.unionByName(self._spent.now().withColumn("_new", F.lit(False)), allowMissingColumns=True)
            both = settled(self._held.join(small(known, JOIN_BYTES, n + self._rows), "src", "left").where("_new is null or _new"), "links")
            self._held, self._spent, self._size, self._rows = both.where("_new is null").select(self._held.columns), None, None, 0
            return both.where("_new").drop("_new")
        if self._spent is None:
            self._spent = Pile(front.select("src"), "spent")
        else:
            self._spent.add(front.select("src"))
        self._rows += n
        return self._held.join(small(front, JOIN_BYTES, n), "src")


class Waiting:
    """Nodes that have some of the ``want`` edges they wait for: ``c`` of them, and what these have brought.

    ``own`` names the nodes' columns, the id first; ``sums`` are the aggregates that put two rows of a node together.
    """

    def __init__(self, own: list[str], *sums: Column):
        self._own, self._sums, self._met = own, (F.sum("c").alias("c"), *sums), None

    def merged(self, hits: DataFrame) -> DataFrame:
        """A row for each node of ``hits``, which has one for each edge; those that wait for one edge are so already."""
        hits = hits.withColumn("c", F.lit(1).cast("long"))
        return hits.where("want = 1").unionByName(hits.where("want > 1").groupBy(*self._own).agg(*self._sums))

    def complete(self, found: DataFrame) -> tuple[DataFrame, int]:
        """The nodes that have all their edges now, with this round's rows in ``found`` (settled), and the number of edges in it."""
        n, part = found.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") < F.col("want"), 1))).first()
        ready, some = found.where("c = want"), found.where("c < want")
        if part and self._met is None:
            self._met = Pile(some, "met")
        elif part:
            self._met.add(some)
            touched = self._met.now().join(small(some.select(self._own[0]), JOIN_BYTES, part), self._own[0], "left_semi").groupBy(*self._own).agg(*self._sums)
            ready = ready.unionByName(touched.where("c = want"))
        return ready, n


def edges_of(rules: DataFrame) -> DataFrame:
    """``src, dst, rule_id``: input to output."""
    return rules.select("rule_id", F.explode("outputs").alias("dst"), "inputs").select(F.explode("inputs").alias("src"), "dst", "rule_id").distinct()


def sources(edges: DataFrame) -> DataFrame:
    """Nodes that nothing produces."""
    return edges.select(F.col("src").alias("name")).distinct().join(shuffled(edges.select(F.col("dst").alias("name"))), "name", "left_anti")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()


def wildcard_matches(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """``rule_id, path, stem``: rules whose pattern (one ``%``, matching something) fits a path.

    Patterns come from rule files and state the query: every path is tested
    against all of them.  They are broadcast if their measured size allows.
    """
    at = F.instr("pattern", "%")
    own = patterns.where(at > 0).select("rule_id", F.col("pattern").substr(F.lit(1), at - 1).alias("_a"), F.col("pattern").substr(at + 1, F.length("pattern")).alias("_b"))
    fits = F.col("path").startswith(F.col("_a")) & F.col("path").endswith(F.col("_b")) & (F.length("path") > F.length("_a") + F.length("_b"))
    stem = F.col("path").substr(F.length("_a") + 1, F.length("path") - F.length("_a") - F.length("_b"))
    return paths.join(small(own), fits).select("rule_id", "path", stem.alias("stem"))


def instantiated(rules: DataFrame, stems: DataFrame) -> DataFrame:
    """A rule for each (rule, stem), with the stem for every ``%``."""
    own = rules.join(stems.select("rule_id", "stem").distinct(), "rule_id")

    def fill(c: str):
        return F.transform(c, lambda x: F.replace(x, F.lit("%"), F.col("stem")))

    return own.withColumns({"outputs": fill("outputs"), "inputs": fill("inputs")})


def satisfiable(rules: DataFrame, available: DataFrame) -> DataFrame:
    """``rule_id`` of the rules all of whose inputs are available or made by such rules: the least fixpoint."""
    rules = settled(rules.select("rule_id", "outputs", "inputs"), "rules")
    have = available.select("path").distinct().withColumn("have", F.lit(True))
    makes = rules.select(F.col("rule_id").alias("src"), F.explode("outputs").alias("path"))
    made = makes.groupBy("path").agg(F.count(F.lit(1)).alias("makers"), F.min("src").alias("src"))
    held = rules.select("rule_id", F.posexplode_outer("inputs").alias("at", "path")).join(shuffled(have), "path", "left").join(shuffled(made), "path", "left")
    place = W.partitionBy("rule_id").orderBy("src")
    want = F.count(F.when(F.col("at").isNotNull() & F.col("have").isNull(), 1)).over(place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    base = held.select("rule_id", "path", "have", "makers", "src", F.row_number().over(place).alias("_n"), want.alias("want"))
    base = settled(base.where("(want = 0 and _n = 1) or (want > 0 and have is null and makers is not null)").select("rule_id", "path", "makers", "src", "want"), "base")
    links = Links(base.where("want > 0 and makers = 1").select("src", "rule_id", "want"))
    shared = settled(base.where("want > 0 and makers > 1").select("path", "rule_id", "want"), "shared")
    several = shared.count()
    if several:  # the first of a path's makers counts, the others no more
        makers = settled(makes.join(small(shared.select("path"), JOIN_BYTES, several), "path", "left_semi"), "makers")
        seen = Pile(shared.where("false").select("path"), "seen")
    good, waiting = Pile(base.where("want = 0").select("rule_id"), "good"), Waiting(["rule_id", "want"], F.sum("link").alias("link"))
    front = good.first
    while links.left or several:
        hits = links.of(front.withColumnRenamed("rule_id", "src")).select("rule_id", "want", F.lit(1).cast("long").alias("link"))
        if several:
            new = seen.add(makers.join(small(front.withColumnRenamed("rule_id", "src"), JOIN_BYTES), "src", "left_semi").select("path").distinct().join(small(seen.now(), JOIN_BYTES), "path", "left_anti"))
            hits = hits.union(shared.join(small(new, JOIN_BYTES), "path").select("rule_id", "want", F.lit(0).cast("long")))
        found = settled(waiting.merged(hits), "found")
        links.left -= found.agg(F.coalesce(F.sum("link"), F.lit(0))).first()[0]
        front = good.add(waiting.complete(found)[0].select("rule_id"))
        if front.isEmpty():
            break
    return good.now()


def first_candidate(candidates: DataFrame) -> DataFrame:
    """One rule for each path: the first satisfiable one, explicit before wildcard, in source order; else the first of all.

    ``candidates`` has ``path, rule_id, ord, wildcard, ok``.
    """
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.col("ok").desc(), "wildcard", "ord"))
    return candidates.withColumn("_n", rank).where("_n = 1").drop("_n")


def goals(rules: DataFrame, named: list[str] | None = None, default: list[str] | None = None) -> DataFrame:
    """``name`` of what to make: what is named, else the default, else the first output of the first rule by ``ord``."""
    spark, asked = rules.sparkSession, named or default
    if not asked:
        first = rules.where(F.size("outputs") > 0).agg(F.min_by(F.get("outputs", F.lit(0)), "ord").alias("name")).first()
        if first.name is None:
            raise ValueError("no goal: nothing is named, there is no default and no rule has an output")
        asked = [first.name]
    return spark.createDataFrame([(x,) for x in asked], "name string")


def reachable(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """``name`` of the goals and of all that they are made from."""
    back = settled(edges.select("src", "dst").distinct(), "edges")
    front = settled(goals.select(F.col(goals.columns[0]).alias("name")).distinct(), "front")
    seen, n = Pile(front, "seen"), 0
    while new := front.count():
        n += new
        step = small(front, JOIN_BYTES, new).join(back, F.col("name") == F.col("dst")).select(F.col("src").alias("name")).distinct()
        front = seen.add(step.join(small(seen.now(), JOIN_BYTES, n), "name", "left_anti"))
    return seen.now()


def layers(edges: DataFrame) -> DataFrame:
    """``name, layer``: the longest path from a source; a cycle raises.

    A node is placed when all its inputs are; nodes that never are lie on or
    behind a cycle.
    """
    own = settled(edges.select("src", "dst").distinct(), "edges")
    links = Links(settled(own.join(shuffled(own.groupBy("dst").agg(F.count(F.lit(1)).alias("want"))), "dst"), "wanted"))
    placed, waiting = Pile(sources(own).select("name", F.lit(0).alias("layer")), "placed"), Waiting(["dst", "want"], F.max("m").alias("m"))
    front = placed.first
    while links.left:
        hits = links.of(front.withColumnRenamed("name", "src"))
        found = settled(waiting.merged(hits.select("dst", "want", F.col("layer").alias("m"))), "found")
        ready, n = waiting.complete(found)
        if not n:
            left = nodes(own).join(shuffled(placed.now()), "name", "left_anti").orderBy("name").limit(5).collect()
            raise ValueError("cycle at " + ", ".join(r.name for r in left))
        links.left -= n
        front = placed.add(ready.select(F.col("dst").alias("name"), (F.col("m") + 1).alias("layer")))
    return placed.now()


def staleness(rules: DataFrame, files: DataFrame, force: bool = False, external: DataFrame | None = None) -> DataFrame:
    """``rule_id, will_run, eff``, settled layer by layer from the sources up; a cycle raises.

    A rule runs if forced, if the rule of an input runs, if a missing input that
    no rule makes will come from an active job (``path`` in ``external``), if an
    output that is not temporary is missing, or if its oldest output is older
    than its newest input.  ``eff`` is the time its consumers see: of its oldest
    output, or, if none is there, of its newest input.  A source that is missing
    has no time.  A rule without a body goes by the same rule, but is no job.
    """
    none = F.array().cast("array<string>")
    both = rules.select("rule_id", "temp", F.size(F.coalesce("outputs", none)).alias("_n"), F.posexplode(F.concat(F.coalesce("outputs", none), F.coalesce("inputs", none))).alias("_at", "path"))
    made = F.col("_at") < F.col("_n")
    facts = settled(both.select("rule_id", "path", made.alias("made"), F.coalesce(F.when(made, F.col("temp")[F.col("path")]), F.lit(False)).alias("is_temp")), "facts")
    there = shuffled(files.where("`exists`").select("path", "mtime"))
    coming = shuffled(facts.where("false").select("path") if external is None else external.select("path").distinct()).withColumn("coming", F.lit(True))
    # Both joins below shuffle the same columns of makes and files, so Spark does so once.
    makes = shuffled(facts.where("made and path is not null").select(F.col("path").alias("_path"), F.col("rule_id").alias("maker"), "is_temp"))
    same, blank, gone = F.col("_path") == F.col("path"), F.lit(None), F.col("mtime").isNull()
    outs = makes.join(there, same, "left").select(F.col("maker").alias("rule_id"), blank.alias("maker"), blank.alias("held"), F.col("mtime").alias("oldest"), (gone & ~F.col("is_temp")).alias("run"), F.lit(True).alias("made"))
    source = ~F.col("made") & (F.col("maker").isNull() | F.col("is_temp").isNull())
    uses = facts.where("not made or path is null").select("rule_id", "path", "made").join(there, "path", "left").join(makes, same, "left").join(coming, "path", "left")  # an output without a path is missing
    uses = uses.select("rule_id", "maker", F.when(source, F.col("mtime")).alias("held"), blank.alias("oldest"), (F.col("made") | (source & gone & F.coalesce("coming", F.lit(False)))).alias("run"), "made")
    own = ["rule_id", "want", "run", "held", "oldest"]
    place = W.partitionBy("rule_id").orderBy("maker")
    all_ = place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = outs.unionByName(uses.where("made or run or maker is not null or held is not null")).select(
        "rule_id", "maker", F.row_number().over(place).alias("_n"), F.bool_or("made").over(all_).alias("_makes"), F.count("maker").over(all_).alias("want"),
        F.bool_or("run").over(all_).alias("run"), F.max("held").over(all_).alias("held"), F.min("oldest").over(all_).alias("oldest"))
    runs = F.col("run") | F.coalesce(F.col("oldest") < F.col("held"), F.lit(False))
    base = base.where("_makes and (maker is not null or (want = 0 and _n = 1))").select("maker", "rule_id", "want", runs.alias("run"), F.when(F.col("oldest").isNull(), F.col("held")).alias("held"), "oldest")
    base = settled(base, "base")
    links = Links(base.where("maker is not null").withColumnRenamed("maker", "src"))

    def decided(ready: DataFrame) -> DataFrame:
        newest = F.greatest("held", "newest")
        old = F.coalesce(F.col("oldest") < newest, F.lit(False))
        return ready.select("rule_id", (F.lit(force) | F.col("rebuilt") | F.col("run") | old).alias("will_run"), F.coalesce("oldest", newest).alias("eff"))

    done = Pile(decided(base.where("want = 0").withColumns({"rebuilt": F.lit(False), "newest": F.lit(None).cast("long")})), "done")
    front, waiting = done.first, Waiting(own, F.bool_or("rebuilt").alias("rebuilt"), F.max("newest").alias("newest"))
    while links.left:
        hits = links.of(front.withColumnRenamed("rule_id", "src"))
        found = settled(waiting.merged(hits.select(*own, F.col("will_run").alias("rebuilt"), F.col("eff").alias("newest"))), "found")
        ready, n = waiting.complete(found)
        if not n:
            raise ValueError("cycle among the rules")
        links.left -= n
        front = done.add(decided(ready))
    return done.now()


def to_build(rules: DataFrame, stale: DataFrame, files: DataFrame) -> DataFrame:
    """``rule_id`` of what must be made: rules that run, and makers of missing inputs of what is made."""
    run = settled(stale.where("will_run").select("rule_id"), "run")
    runs = run.count()
    missing = rules.select("rule_id", F.explode("inputs").alias("path")).join(shuffled(files.where("`exists`")), "path", "left_anti")
    made = missing.join(shuffled(rules.select(F.col("rule_id").alias("maker"), F.explode("outputs").alias("path"))), "path").select("rule_id", "maker")
    more = settled(made.join(small(run.withColumnRenamed("rule_id", "maker"), JOIN_BYTES, runs), "maker", "left_anti").distinct(), "missing")
    front, new, added, n = run, runs, None, 0
    while new:
        step = more.join(small(front, JOIN_BYTES, new), "rule_id", "left_semi").select(F.col("maker").alias("rule_id")).distinct()
        if added is None:
            added = Pile(step, "build")
            front = added.first
        else:
            front = added.add(step.join(small(added.now(), JOIN_BYTES, n), "rule_id", "left_anti"))
        new = front.count()
        n += new
    return run if added is None else run.union(added.now())


def jobs(rules: DataFrame, build: DataFrame) -> DataFrame:
    """The rules to build that are jobs: those with a body.  Others only gather inputs."""
    return rules.where("has_body").join(small(build.select("rule_id"), JOIN_BYTES), "rule_id", "left_semi")


def dependencies(rules: DataFrame, build: DataFrame, stale: DataFrame, files: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """``rule_id, producer, job_id``: what each job to build waits for.

    An input made by a rule makes an edge to it if that rule runs or the input
    is missing, and if it has a body: a rule without one is no job to wait for.
    A missing input that no rule makes has an edge to the active job that will
    make it (``path, owner`` in ``external``).
    """
    uses = jobs(rules, build).select("rule_id", F.explode(F.array_distinct("inputs")).alias("path"))
    makes = rules.select(F.col("rule_id").alias("producer"), F.col("has_body").alias("is_job"), F.explode("outputs").alias("path"))
    runs = stale.where("will_run").select(F.col("rule_id").alias("producer"))
    there = files.where("`exists`").select("path", F.lit(True).alias("there"))
    held = uses.join(shuffled(makes), "path", "left").join(shuffled(there), "path", "left").where("(producer is not null and is_job) or (producer is null and there is null)")
    held = settled(held.select("rule_id", "producer", "path", "there"), "uses")
    made = held.where("producer is not null").select("rule_id", "producer", "there")
    own = made.where("there is null").union(made.where("there").join(shuffled(runs), "producer", "left_semi").select("rule_id", "producer", "there")).select("rule_id", "producer", F.lit(None).cast("string").alias("job_id")).distinct()
    if external is None:
        return own
    other = held.where("producer is null").join(shuffled(external.select("path", "owner")), "path")
    return own.union(other.select("rule_id", F.col("producer"), F.col("owner").alias("job_id")).distinct())


def unmakeable(rules: DataFrame, files: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """``rule_id, path``: inputs that are missing, that no rule makes and, if given, no active job (``path`` in ``external``)."""
    out = rules.select("rule_id", F.explode("inputs").alias("path")).distinct()
    for held in (rules.select(F.explode("outputs").alias("path")), files.where("`exists`").select("path"), *(() if external is None else (external.select("path"),))):
        out = out.join(shuffled(held.distinct()), "path", "left_anti")
    return out.select("rule_id", "path")


def up_to_date(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """``key, ok``: all outputs are there and no older than the newest input that is there; without outputs, not.

    Both tables have ``key, mtime``, null where the file is missing.
    """
    newest = inputs.groupBy("key").agg(F.max("mtime").alias("newest"))
    held = outputs.groupBy("key").agg(F.min("mtime").alias("oldest"), F.bool_and(F.col("mtime").isNotNull()).alias("all"))
    return held.join(newest, "key", "left").select("key", (F.col("all") & (F.col("newest").isNull() | (F.col("oldest") >= F.col("newest")))).alias("ok"))


def ready(rules: DataFrame, available: DataFrame) -> DataFrame:
    """Rules all of whose inputs are available now."""
    held = rules.select("rule_id", F.explode_outer("inputs").alias("path")).join(available.select("path").distinct().withColumn("ok", F.lit(True)), "path", "left")
    return held.groupBy("rule_id").agg(F.bool_and(F.col("path").isNull() | F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").select("rule_id")


def collapsed(dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """``consumer, group, whole``: whether a consumer depends on every member of an array.  ``dependencies``: consumer, group, index; ``members``: group, index."""
    size = members.groupBy("group").agg(F.countDistinct("index").alias("n"))
    return dependencies.groupBy("consumer", "group").agg(F.countDistinct("index").alias("c")).join(size, "group").select("consumer", "group", (F.col("c") == F.col("n")).alias("whole"))


def elementwise(pairs: DataFrame) -> DataFrame:
    """``consumer_group, producer_group, co``: whether every member depends on the member of its own index alone.  ``pairs``: consumer_group, consumer_index, producer_group, producer_index."""
    per = pairs.groupBy("consumer_group", "producer_group", "consumer_index").agg(F.countDistinct("producer_index").alias("c"), F.min("producer_index").alias("p"))
    return per.groupBy("consumer_group", "producer_group").agg(F.bool_and((F.col("c") == 1) & (F.col("p") == F.col("consumer_index"))).alias("co"))


def duplicate_indexes(members: DataFrame, group: str = "group", index: str = "index") -> DataFrame:
    return members.groupBy(group, index).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_signature(members: DataFrame, group: str = "group", signature: str = "signature") -> DataFrame:
    """``group, ok``: whether all members of a group have the same settings."""
    return members.groupBy(group).agg((F.countDistinct(signature) == 1).alias("ok"))


def dot(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """``ord, line`` of a graph text: nodes by name (``temp`` dashed, ``source`` as a note), then edges."""
    from ..functions.strings import dot_quote

    style = F.when(F.col("temp"), " [style=dashed]").when(F.col("source"), " [shape=note]").otherwise("")
    head = node_table.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit("").alias("name"), F.lit("digraph {").alias("line"))
    body = node_table.select(F.lit(1).alias("ord"), "name", F.concat(F.lit("  "), dot_quote(F.col("name")), style, F.lit(";")).alias("line"))
    arrows = edges.select(F.lit(2).alias("ord"), F.concat_ws("\t", "src", "dst").alias("name"), F.concat(F.lit("  "), dot_quote(F.col("src")), F.lit(" -> "), dot_quote(F.col("dst")), F.lit(";")).alias("line")).distinct()
    tail = head.select(F.lit(3).alias("ord"), "name", F.lit("}").alias("line"))
    return head.union(body).union(arrows).union(tail).orderBy("ord", "name").select("ord", "line")
