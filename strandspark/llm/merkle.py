"""Merkle manifest of a dataset: a hash tree over the documents of each group, and one over the groups.

Rows are hashed (``leaf_hash``), sorted globally by group and order, and cut into parts of at most PART rows
by their place in that sort. What precedes a part is known from counts of parts, so each part is an indexed
stretch of its group's leaves. A part runs a mountain range over its stretch: a stack of peaks, onto which
leaves are pushed; whenever the top ``fanout`` peaks are one aligned run of a level they carry into their
parent. At the end of a group its last, shorter run carries too; nothing is padded. What a part can't carry,
because its stretch begins or ends inside a run, stays on the stack: a few peaks a level.

These peaks are merged in tiers of TIER levels: a tier's task gets the peaks below one node ``TIER`` levels
up, which are never more than that node has descendants, and completes all nodes between. A group's top node
is its subroot; subroots, in order of their groups, are leaves of one more tree by the same code.

Proofs need the siblings along a leaf's path. A part runs its stack again, this time keeping the node records
it emits, and asks for nodes beyond its stretch by (group, level, index): some eight a level and part. So a
group of any size is hashed by as many tasks as it has parts, and no task or driver sees all of a level.

Defined results: null columns hash as ``-``, others as their UTF-8 length, ``:`` and value; a null group is a
group and comes first; within a group rows ascend by id (null first), rows of the same id by leaf, and equal
leaves in any order, which changes no node; an empty table gives an empty table; empty and very long texts are
values like others. Carried columns keep their names, which must differ from those of the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandspark.session import materialise, ship

#: Rows of a part are 2 ** PART_BITS at most; levels that a merging task completes.
PART_BITS, TIER = 13, 7
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns' lengths and values, as text; a null is ``-``."""
    text = [c.cast("string") for c in columns]
    fields = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.sha2(F.concat(*fields), 256)


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def nodes_at(total: int, level: int, fanout: int) -> int:
    return -(-total // fanout**level)


def height(total: int, fanout: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while fanout**h < total:
        h += 1
    return h


class MountainRange:
    """Peaks over the leaves ``start``, ``start + 1``, ... of ``total``; ``record`` gets each node that is completed."""

    def __init__(self, start: int, total: int, fanout: int, record: Callable[[int, int, str], None] | None = None):
        self.next, self.total, self.fanout, self.record = start, total, fanout, record
        self.peaks: list[tuple[int, int, str]] = []

    def append(self, digest: str) -> None:
        self._push(0, self.next, digest)
        self.next += 1
        if self.next == self.total:  # last runs may be short
            for level in range(height(self.total, self.fanout)):
                last = nodes_at(self.total, level, self.fanout) - 1
                if last % self.fanout != self.fanout - 1:
                    self._carry(level, last)

    def _push(self, level: int, index: int, digest: str) -> None:
        if self.record:
            self.record(level, index, digest)
        self.peaks.append((level, index, digest))
        if index % self.fanout == self.fanout - 1:
            self._carry(level, index)

    def _carry(self, level: int, last: int) -> None:
        """The run that ends with ``last`` becomes its parent, if all of it is here."""
        size = last % self.fanout + 1
        if len(self.peaks) >= size and self.peaks[-size][:2] == (level, last - size + 1):
            run = [digest for _, _, digest in self.peaks[-size:]]
            del self.peaks[-size:]
            self._push(level + 1, last // self.fanout, parent(run))


def complete(nodes: dict[tuple[int, int], str], base: int, top: int, total: int, fanout: int) -> dict[tuple[int, int], str]:
    """The nodes above ``base`` up to ``top`` that have children among ``nodes``, which holds all or none of a run."""
    made = {}
    for level in range(base, min(top, height(total, fanout))):
        here = {i: d for (k, i), d in (*nodes.items(), *made.items()) if k == level}
        for p in sorted({i // fanout for i in here}):
            run = range(p * fanout, min(p * fanout + fanout, nodes_at(total, level, fanout)))
            made[level + 1, p] = parent([here[i] for i in run])
    return made


@dataclass
class Forest:
    """A tree for each group: ``rows`` by place, ``spans`` of parts, ``nodes`` that no part has alone, ``tops``."""

    rows: DataFrame
    spans: DataFrame
    nodes: DataFrame
    tops: DataFrame
    fanout: int


def _by_part(left: DataFrame, right: DataFrame, f, schema) -> DataFrame:
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(f, schema)


def _stretches(left: pa.Table, right: pa.Table):
    """A part's rows by place, and each span with its first row there."""
    left, at = left.sort_by("at"), 0
    for span in right.sort_by("first").to_pylist():
        yield left.slice(at, span["n"]), span
        at += span["n"]


def grow(rows: DataFrame, order: list[str], fanout: int) -> Forest:
    """Trees over the ``digest`` of ``rows`` (group, digest, ...), whose leaves ascend by ``order`` within a group."""
    ship(rows.sparkSession)
    kind = rows.schema["group"].dataType.simpleString()
    placed = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.shiftright("at", PART_BITS)), "merkle-rows")
    counted = placed.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = counted.withColumn("start", F.sum("n").over(earlier) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("group")))
    spans = materialise(spans, "merkle-spans")

    def peaks(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for leaves, span in _stretches(left, right):
            stack = MountainRange(span["start"], span["total"], fanout)
            for d in leaves.column("digest").to_pylist():
                stack.append(d)
            out += [(span["group"], span["total"], *p) for p in stack.peaks]
        return _nodes(out, right.schema.field("group").type)

    def merge(table: pa.Table) -> pa.Table:
        known = {(x["level"], x["idx"]): x["digest"] for x in table.to_pylist()}
        first = table.slice(0, 1).to_pylist()[0]
        made = complete(known, first["base"], first["base"] + TIER, first["total"], fanout)
        return _nodes([(first["group"], first["total"], *k, d) for k, d in made.items()], table.schema.field("group").type)

    schema = f"group {kind}, total long, level int, idx long, digest string"
    own = materialise(_by_part(placed.select("part", "at", "digest"), spans, peaks, schema), "merkle-peaks")
    nodes = own
    largest = spans.agg(F.max("total")).first()[0] or 0
    tops = own.limit(0)
    for base in range(0, height(largest, fanout), TIER):
        level = own.where((F.col("level") >= base) & (F.col("level") < base + TIER)).unionByName(tops)
        block = F.expr(f"idx div cast(pow({fanout}, {base + TIER} - level) as bigint)")
        made = materialise(level.withColumn("base", F.lit(base)).withColumn("block", block).groupBy("group", "block").applyInArrow(merge, schema), "merkle-merged")
        nodes, tops = nodes.unionByName(made), made.where(F.col("level") == base + TIER)
    is_top = (F.pow(F.lit(fanout), "level") >= F.col("total")) & ((F.col("level") == 0) | (F.pow(F.lit(fanout), F.col("level") - 1) < F.col("total")))
    return Forest(placed, spans, nodes, nodes.where(is_top).select("group", "digest"), fanout)


def _nodes(rows: list[tuple], kind: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 5
    types = [kind, pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("group", "total", "level", "idx", "digest"), columns, types)})


def _wanted(spans: DataFrame, fanout: int) -> DataFrame:
    """(part, group, level, idx) of nodes in runs along the paths of a span's leaves that the span doesn't complete."""
    power = "cast(pow({0}, level) as bigint)".format(fanout)
    levels = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(fanout), k) < F.col("total"))
    x = spans.withColumn("level", F.explode(levels)).withColumn("width", F.expr(power))
    x = x.withColumn("count", F.expr("(total + width - 1) div width"))
    x = x.withColumn("low", F.expr(f"start div width div {fanout} * {fanout}")).withColumn("high", F.expr(f"least((start + n - 1) div width div {fanout} * {fanout} + {fanout}, count) - 1"))
    x = x.withColumn("own", F.expr("(start + width - 1) div width")).withColumn("stop", F.expr("if(start + n = total, count, (start + n) div width)"))
    before = F.expr("if(own > low, sequence(low, least(own - 1, high)), array())").cast("array<bigint>")
    after = F.expr("if(greatest(stop, low) <= high, sequence(greatest(stop, low), high), array())").cast("array<bigint>")
    return x.select("part", "group", "level", F.explode(F.array_union(before, after)).alias("idx"))


def paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``top``, ``root`` and ``path``: the siblings before and after it, joined, on each level.

    ``above`` (group, digest, root, path) has the groups' own paths, which are appended.
    """
    fanout, rows = forest.fanout, forest.rows
    wanted = _wanted(forest.spans, fanout).alias("w")
    nodes = forest.nodes.alias("n")
    same = F.col("w.group").eqNullSafe(F.col("n.group")) & (F.col("w.level") == F.col("n.level")) & (F.col("w.idx") == F.col("n.idx"))
    found = wanted.join(nodes, same).select("w.part", "w.group", "n.level", "n.idx", "n.digest")
    found = found.groupBy("part", "group").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("others"))
    tops = above if above is not None else forest.tops.withColumn("root", F.col("digest")).withColumn("path", F.array().cast(PATH))
    spans = forest.spans.alias("s").join(found.alias("f"), (F.col("s.part") == F.col("f.part")) & F.col("s.group").eqNullSafe(F.col("f.group")), "left").select("s.*", "f.others")
    spans = spans.alias("s").join(tops.alias("t"), F.col("s.group").eqNullSafe(F.col("t.group"))).select("s.*", F.col("t.digest").alias("top"), "t.root", "t.path")
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    out = T.StructType([*[f for f in rows.schema.fields if f.name not in ("at", "part")], *[T.StructField(n, T.StringType()) for n in ("top", "root")], T.StructField("path", PATH)])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for leaves, span in _stretches(left, right):
            known: dict[tuple[int, int], str] = {(x["level"], x["idx"]): x["digest"] for x in span["others"] or []}
            stack = MountainRange(span["start"], span["total"], fanout, lambda k, i, d, known=known: known.__setitem__((k, i), d))
            for d in leaves.column("digest").to_pylist():
                stack.append(d)
            counts = [nodes_at(span["total"], k, fanout) for k in range(height(span["total"], fanout))]
            shared: dict[tuple[int, int], tuple[str, str]] = {}
            lefts, rights = [], []
            for i in range(span["start"], span["start"] + span["n"]):
                for level, count in enumerate(counts):
                    at = (level, i)
                    if at not in shared:
                        low = i - i % fanout
                        join = lambda some, level=level: "".join(known[level, k] for k in some)
                        shared[at] = join(range(low, i)), join(range(i + 1, min(low + fanout, count)))
                    lefts.append(shared[at][0])
                    rights.append(shared[at][1])
                    i //= fanout
                lefts += [p["left"] for p in span["path"]]
                rights += [p["right"] for p in span["path"]]
            each = len(counts) + len(span["path"])
            steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(pair))
            path = pa.ListArray.from_arrays(pa.array(range(0, span["n"] * each + 1, each) if each else [0] * (span["n"] + 1), pa.int32()), steps)
            own = leaves.select([f.name for f in out.fields if f.name in leaves.column_names])
            for name in ("top", "root"):
                own = own.append_column(name, pa.array([span[name]] * span["n"], pa.string()))
            tables.append(own.append_column("path", path))
        return pa.concat_tables(tables)

    return _by_part(rows, spans, prove, out)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", carry: list[str] | None = None, fanout: int = 3) -> DataFrame:
    """(id, group, leaf, subroot, root, proof, *carry) for each row; ``columns`` are what its leaf hashes.

    ``proof`` has the siblings (left, right) on each level from the leaf to the root.
    """
    carry = carry or []
    kept = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    leaves = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in columns]).alias("digest"), F.monotonically_increasing_id().alias("tie"), *kept)
    trees = grow(materialise(leaves, "merkle-leaves"), ["id", "digest", "tie"], fanout)
    tops = materialise(trees.tops, "merkle-subroots").select(F.lit(0).alias("group"), F.col("group").alias("name"), "digest")
    roots = paths(grow(tops, ["name"], fanout)).select(F.col("name").alias("group"), "digest", "root", "path")
    found = paths(trees, materialise(roots, "merkle-roots"))
    return found.select(F.col("id").alias(id_col), F.col("group").alias(group_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.col("path").alias("proof"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])
