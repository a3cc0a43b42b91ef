"""N-gram Jaccard self-join by chosen paths.

Documents become sets of ``shingle``-word runs (a shorter text with words is
one run); sets that are equal are one node with a multiplicity, so copies are
never paired.  Each set is embedded as ``COORDINATES`` minimum hashes; two sets
agree in a coordinate with a probability equal to their similarity.

A run of the join starts with all sets in one bucket.  A bucket draws one or
two coordinates (1 / threshold on average), the same for all its members, and
passes each member on to the bucket of its value there; buckets of at most
``brute`` members, or at the last level, are compared by their embeddings.  The
number of runs follows from the target recall at the threshold, over all shares
of coordinates in which a pair at the threshold may agree.  Buckets
larger than ``bucket_rows`` are split further by Spark; what cannot be split is
a dense cluster: all its members are compared with ``LEADERS`` of them a round,
and those within a tenth of one need no more comparing, until it is small.

Pairs whose embeddings agree at all closely join a group of candidates; each
document's whole set is then sent once to its group, where every pair is
verified exactly.  Groups of more than ``block`` members are verified in pairs
of blocks.  Links are counted, never listed, and each task hands on a spanning
forest of its links, so no step emits the pairs of a group.

Documents without words, or with a null id, are alone in their class (its id is
theirs).  Rows that share an id share a class; ``keep_one`` takes one row of
them.  Texts of any length count whole, an empty table has no classes, and
columns of any name stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, fresh, settled, small
from .components import components
from .text import Words, chunks, mix, windows

COORDINATES = 64
LEVELS = 4
#: Members of a dense bucket that all others are compared with in one round.
LEADERS = 64
#: Embeddings that agree in so large a share of the threshold make candidates.
LOOSE = 0.75

_rng = np.random.default_rng(7)
_ODD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, ordered by row and hash."""
    hashes = words.hashes()
    at, value = windows(words, hashes, width)
    row = words.row()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        first, n = words.first[short], words.count[short]
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = n > k
            total[more] = mix(total[more] * np.uint64(3) + hashes[first[more] + k])
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(total + n.astype(np.uint64))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def embed(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty((len(first), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(((value ^ _SALT[i]) * _ODD[i]) >> np.uint64(32), first)
    return out


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, value = shingle_sets(Words(part.column("text")), width)
                size = np.bincount(row, minlength=part.num_rows)
                some = np.flatnonzero(size)
                first = np.cumsum(size[some]) - size[some]
                s1, s2 = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                sketch = [None] * part.num_rows
                if len(some):
                    s1[some], s2[some] = np.add.reduceat(mix(value), first), np.add.reduceat(mix(value ^ np.uint64(0xABCDEF12345)), first)
                    for i, e in zip(some.tolist(), embed(value, first), strict=True):
                        sketch[i] = e.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sketch, pa.binary())], names=["doc_id", "s1", "s2", "sketch"])

    return run


def drawn(path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two coordinates for each bucket, and whether the second counts: 1 / threshold on average."""
    h = mix(path)
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    return first, second, (h >> np.uint64(40)).astype(np.float64) / 2**24 < 1 / threshold - 1


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path ^ mix((coordinate.astype(np.uint64) << np.uint64(32)) | value.astype(np.uint64)))


def found_by(runs: int, threshold: float, levels: int = LEVELS) -> float:
    """Probability that ``runs`` runs find a pair at the threshold, were it to go down all levels.

    All runs share one embedding: the pair agrees in a binomial number of its
    coordinates, and only given that number are the runs independent.
    """
    two, least, total = 1 / threshold - 1, math.floor(threshold * LOOSE * COORDINATES), 0.0
    for k in range(least, COORDINATES + 1):
        found = 1.0
        for _ in range(levels):
            x = k / COORDINATES * found
            found = (1 - two) * x + two * (1 - (1 - x) ** 2)
        total += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * (1 - (1 - found) ** runs)
    return total


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """The fewest runs that find a pair at the threshold with probability ``recall``; no runs reach more than its embedding allows."""
    runs, recall = 1, min(recall, found_by(1 << 20, threshold, levels) - 1e-4)
    while found_by(runs, threshold, levels) < recall:
        runs += 1
    return runs


def _split(threshold: float, runs: int = 0):
    """Bucket rows (path, node) of the next level; with ``runs``, of the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            paths, nodes = [], []
            for r in range(runs or 1):
                path = np.full(len(node), mix(np.array([r + 1], np.uint64))[0]) if runs else batch.column("path").to_numpy().view(np.uint64)
                one, two, both = drawn(path, threshold)
                every = np.arange(len(node))
                paths += [_child(path, one, sketch[every, one]), _child(path, two, sketch[every, two])[both]]
                nodes += [node, node[both]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).view(np.int64)), pa.array(np.concatenate(nodes))], names=["path", "node"])

    return run


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member to the least member of its component; ``pairs`` has two columns."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def candidates_in(sketch: np.ndarray, path: int, threshold: float, brute: int, levels: int, reached: int = 1) -> list[tuple[int, int]]:
    """A spanning forest, by place, of what may be similar in one bucket of the level ``reached``."""
    least = math.floor(threshold * LOOSE * COORDINATES)
    edges: set[tuple[int, int]] = set()

    def compare(own: np.ndarray) -> None:
        while len(own) > 4 * brute:  # dense: what is near the leader needs no more comparing than the leader
            agree = (sketch[own] == sketch[own[0]]).sum(1)
            slack = COORDINATES // 10
            edges.update((int(own[i]), int(own[0])) for i in np.flatnonzero(agree >= least - slack) if i)
            own = own[agree < COORDINATES - slack]
        if len(own) < 2:
            return
        s = sketch[own]
        agree = np.zeros((len(own), len(own)), np.uint8)
        for c in range(COORDINATES):
            agree += s[:, c, None] == s[None, :, c]
        a, b = np.nonzero(np.triu(agree >= least, 1))
        edges.update((int(own[i]), int(own[j])) for i, j in forest(len(own), np.stack([a, b], 1)))

    todo = [(np.arange(len(sketch)), np.uint64(path), reached)]
    while todo:
        own, at, level = todo.pop()
        if len(own) < 2:
            continue
        if len(own) <= brute or level >= levels:
            compare(own)
            continue
        one, two, both = drawn(np.array([at]), threshold)
        for c in (one[0], two[0])[: 1 + int(both[0])]:
            value = sketch[own, c]
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    todo.append((own[group], _child(np.array([at]), np.array([c]), value[group[:1]])[0], level + 1))
    return forest(len(sketch), np.array(sorted(edges), np.int64).reshape(-1, 2))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, from batches in which equal keys are next to each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0].as_py() != part.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _compare(threshold: float, brute: int, levels: int, reached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for bucket in grouped(batches, ["path"]):
            if bucket.num_rows < 2:
                continue
            node = bucket.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            for a, b in candidates_in(sketch, int(np.int64(bucket.column("path")[0].as_py()).view(np.uint64)), threshold, brute, levels, reached):
                u.append(int(node[a]))
                v.append(int(node[b]))
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _lead(threshold: float):
    """Rows of a dense bucket with its leaders: those that are near, and whether the row is done."""
    least, slack = math.floor(threshold * LOOSE * COORDINATES), COORDINATES // 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, done = [], []
            own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            leaders = batch.column("leaders")
            for i in range(batch.num_rows):
                held = leaders[i].values
                sketch = np.frombuffer(b"".join(held.field("leader_sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                agree = (sketch == own[i]).sum(1)
                near.append(held.field("leader").to_numpy()[agree >= least - slack])
                done.append(bool(agree.max() >= COORDINATES - slack))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("node"), pa.array(near, pa.list_(pa.int64())), pa.array(done, pa.bool_())], names=["path", "node", "near", "done"])

    return run


def candidate_edges(nodes: DataFrame, threshold: float, recall: float, brute: int, bucket_rows: int, levels: int = LEVELS) -> DataFrame:
    """``u, v``: edges that join all sets that may be similar.  ``nodes`` has ``node, sketch``."""
    sketched = nodes.select("node", "sketch")

    def members(rows: DataFrame) -> DataFrame:
        """The rows of buckets with several members, and their number ``c``."""
        rows = settled(rows, "bucket-rows")
        sized = rows.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return rows.join(sized.select(apart(F.col("path")).alias("_p"), "c"), apart(F.col("path")) == F.col("_p")).select("path", "node", "c")

    found = []

    def compare(rows: DataFrame, reached: int) -> None:
        own = rows.select("path", "node").join(sketched, "node")
        n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
        dealt = own.repartition(int(n), "path").sortWithinPartitions("path")
        found.append(dealt.mapInArrow(_compare(threshold, brute, levels, reached), "u long, v long"))

    rows = settled(members(sketched.mapInArrow(_split(threshold, runs_for(recall, threshold, levels)), "path long, node long")), "buckets")
    compare(rows.where(F.col("c") <= bucket_rows), 1)
    big = rows.where(F.col("c") > bucket_rows)
    for reached in range(2, levels + 1):
        if big.isEmpty():
            break
        rows = settled(members(big.select("path", "node").join(sketched, "node").mapInArrow(_split(threshold), "path long, node long")), "buckets")
        compare(rows.where(F.col("c") <= bucket_rows), reached)
        big = rows.where(F.col("c") > bucket_rows)
    while not big.isEmpty():
        lead = big.groupBy("path", F.pmod(F.xxhash64("node"), F.lit(LEADERS))).agg(F.min("node").alias("leader")).select("path", "leader")
        lead = lead.join(sketched.select(F.col("node").alias("leader"), F.col("sketch").alias("leader_sketch")), "leader")
        lead = settled(lead.groupBy("path").agg(F.collect_list(F.struct("leader", "leader_sketch")).alias("leaders")), "leaders")
        dealt = big.select("path", "node").join(sketched, "node").join(small(lead), "path").mapInArrow(_lead(threshold), "path long, node long, near array<long>, done boolean")
        dealt = settled(dealt, "led")
        found.append(dealt.select(F.col("node").alias("u"), F.explode("near").alias("v")).where("u <> v"))
        rows = settled(members(dealt.where("not done").select("path", "node")), "buckets")
        compare(rows.where(F.col("c") <= bucket_rows), levels)
        big = rows.where(F.col("c") > bucket_rows)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _deal(width: int):
    """The whole set of each document, with its places in the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, value = shingle_sets(Words(part.column("text")), width)
                cuts = np.searchsorted(row, np.arange(1, part.num_rows))
                sets = [v.tobytes() for v in np.split(value, cuts)]
                keep = [part.column(c) for c in ("root", "node", "n", "block", "blocks")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(sets, pa.binary())], names=["root", "node", "n", "block", "blocks", "members"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets of distinct values."""
    if len(sets) <= 3:
        out = np.zeros((len(sets), len(sets)), np.float32)
        for i in range(len(sets)):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    which, place = which[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    which, place = which[order], place[order]
    step = 4096
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [low, low + step])
        m = np.zeros((len(sets), step), np.float32)
        m[which[a:b], place[a:b] - low] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in grouped(batches, ["root", "low", "high"]):
            if group.num_rows < 2:
                continue
            node, n, block = (group.column(c).to_numpy() for c in ("node", "n", "block"))
            sets = [np.frombuffer(b, np.uint64) for b in group.column("members").to_pylist()]
            size = np.array([len(s) for s in sets], np.float64)
            common = overlaps(sets).astype(np.float64)
            linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if group.column("low")[0].as_py() != group.column("high")[0].as_py():
                linked &= block[:, None] != block[None, :]
            links = linked.astype(np.int64) @ n
            out += [(a, None, k) for a, k in zip(node.tolist(), links.tolist(), strict=True) if k]
            order = np.argsort(node)
            pairs = np.stack(np.nonzero(np.triu(linked[np.ix_(order, order)], 1)), 1)
            out += [(int(node[order[a]]), int(node[order[b]]), None) for a, b in forest(len(node), pairs)]
            if len(out) > 50_000:
                yield _packed(out)
                out = []
        yield _packed(out)

    def _packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["u", "v", "links"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999, brute: int = 64, bucket_rows: int = 2048, block: int = 512) -> DataFrame:
    """Per row: ``doc_id, class_id, n_links``.

    ``class_id`` is the least id among the documents joined by links of
    similarity ``threshold`` or more; ``n_links`` is the number of other
    documents, copies included, that a document is linked to itself.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = settled(own.mapInArrow(_sets(shingle), "doc_id long, s1 long, s2 long, sketch binary"), "sets")
    some = sets.where("sketch is not null and doc_id is not null")
    nodes = settled(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("sketch").alias("sketch")), "nodes")
    groups = components(candidate_edges(nodes, threshold, recall, brute, bucket_rows), "candidates")
    groups = groups.union(groups.select("root", "root").distinct())
    sized = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(sized, "root").join(nodes.select("node", "n"), "node").select("root", "node", "n", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).distinct()
    texts = own.where("text is not null").withColumnRenamed("doc_id", "node").join(placed, "node")
    dealt = texts.mapInArrow(_deal(shingle), "root long, node long, n long, block int, blocks int, members binary")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "block", "members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = settled(dealt.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(_verify(threshold), "u long, v long, links long"), "links")
    links = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"), "classes")
    known = nodes.join(roots, "node", "left").join(links, "node", "left")
    known = known.select("s1", "s2", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    alone = sets.where("sketch is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.join(known, ["s1", "s2"]).select("doc_id", "class_id", "n_links").union(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all its columns: of the least id, and among rows of that id the one of the least text hash.

    Rows with a null id are classes of their own and all stay.
    """
    gone, twice, row = fresh(docs, "_gone", "_twice", "_row")
    own = F.col(id_col)
    left = small(settled(classes(docs, id_col, text_col, **options).where("class_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct(), "gone"))
    kept = docs.join(left, own == F.col(gone), "left_anti")
    shared = settled(docs.groupBy(own.alias(twice)).agg(F.count(F.lit(1)).alias("c")).where(F.col(twice).isNotNull() & (F.col("c") > 1)).select(twice), "shared-ids")
    if shared.isEmpty():
        return kept
    shared = small(shared)
    several = kept.join(shared, own == F.col(twice), "left_semi").groupBy(own.alias(twice)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias(row))
    return kept.join(shared, own == F.col(twice), "left_anti").union(several.select(f"{row}.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return classes(table(spark, sf_dir, "documents"))
