"""Embedding near-duplicates by PCA-ordered tiled comparison.

Exact copies collapse first. Unit vectors are rotated onto the principal axes of their second moments,
largest first, so that a few leading coordinates hold most of a product. A k-d tree over the leading
coordinates deals rows into leaves; a row also goes to the leaves whose box it could reach, and each
pair of leaves is one tile job. A tile multiplies leading coordinates with the norm of what is left as
one more coordinate: by Cauchy-Schwarz that bounds the cosine, and only pairs whose bound reaches the
threshold go on to the next coordinates, at last to the exact cosine of the original vectors in double
precision. A tile returns a row for each linked vector: its number of links and its smallest partner by
following links, never the pairs.

The tree's splits come from a sample of at most SAMPLE rows (they only route rows; boxes, moments and
comparisons cover every row). It has at most LEAVES leaves, so what is broadcast is bounded; a leaf
beyond ``leaf_rows`` is cut into chunks by hash, so a tile job's memory is bounded whatever the number of
rows. Vectors of each length have axes and a tree of their own. What boxes can't part is compared whole:
for vectors without structure the work grows with the square of their number.

A node is a distinct vector, named by its smallest id and a 128-bit digest of its components, so rows
that repeat an id with other vectors stay apart.

Defined results: vectors that are null, zero, or that hold null or non-finite components link with
nothing, nor do rows with a null id or vectors of different lengths; repeated rows are vectors each;
very long vectors make leaves of fewer rows; an empty table gives an empty table; only the two columns
named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import join_counted
from strandspark.llm.components import connected_components
from strandspark.llm.simhash import _merge_labels
from strandspark.session import materialise, ship

THRESHOLD = 0.95
#: Components of a leaf's vectors, leaves, sampled rows, coordinates of the tree, rows of a tile, coordinates of a step.
LEAF, LEAVES, SAMPLE, LEADING, TILE, STEP = 2_097_152, 4_096, 20_000, 16, 2_048, 16
SLACK = 1e-9


def _matrix(column: pa.Array, d: int, wire: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), wire).astype(np.float64).reshape(-1, d)


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, d, key, x) and the components' type in x: length, digest and components of a vector that can link, else nulls."""
    wire = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if wire == "<f4" else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 4_096) for whole in batches for k in range(0, whole.num_rows, 4_096)):
            ids, column = b.column(0), b.column(1)
            values = column.flatten()
            x = np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(wire), nan=np.inf, posinf=np.inf, neginf=np.inf) + 0.0  # no negative zeros
            sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            stops = np.cumsum(sizes)
            known = ids.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False)
            d, keys, data = [], [], []
            for ok, stop, size in zip(known.tolist(), stops.tolist(), sizes.tolist()):
                own = x[stop - size : stop]
                if ok and size and np.isfinite(own).all() and own.any():
                    raw = own.tobytes()
                    d.append(size)
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                    data.append(raw)
                else:
                    for c in (d, keys, data):
                        c.append(None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(d, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "d", "key", "x"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, d int, key binary, x binary"), wire


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares of huge nor of tiny components leave the doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, d: int, wire: str) -> np.ndarray:
    """Columns are eigenvectors of the unit vectors' second moments, largest first; d * d sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _unit(_matrix(b.column(0), d, wire))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "value"])

    sums = vectors.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    moments = np.zeros(d * d)
    moments[sums["at"]] = sums["value"]
    return np.linalg.eigh(moments.reshape(d, d))[1][:, ::-1]


class Tree:
    """Median splits along the widest leading coordinate, all leaves at one depth."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, k = depth, sample.shape[1]
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        held = {1: sample}
        for node in range(1, 1 << depth):
            x = held.pop(node)
            self.axis[node] = int(np.argmax(x.var(0))) if len(x) else node % k
            values = x[:, self.axis[node]]
            self.cut[node] = np.median(values) if len(values) else 0.0
            right = values > self.cut[node]
            held[2 * node], held[2 * node + 1] = x[~right], x[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


class Boxes:
    """Bounds of every node's rows, from those of the leaves."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        leaves = len(low)
        self.first = leaves
        self.low, self.high = (np.concatenate([np.full_like(x, f), x]) for x, f in ((low, np.inf), (high, -np.inf)))
        for node in range(leaves - 1, 0, -1):
            self.low[node] = np.minimum(self.low[2 * node], self.low[2 * node + 1])
            self.high[node] = np.maximum(self.high[2 * node], self.high[2 * node + 1])

    def reached(self, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves whose box is within the square root of ``reach``: down the tree, all rows together."""
        row, node = np.arange(len(y)), np.ones(len(y), np.int64)
        while True:
            gap = np.maximum(np.maximum(self.low[node] - y[row], y[row] - self.high[node]), 0)
            on = (gap**2).sum(1) <= reach
            row, node = row[on], node[on]
            if not len(node) or node[0] >= self.first:
                return row, node - self.first
            row, node = np.repeat(row, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()


def _extended(y: np.ndarray, upto: int) -> np.ndarray:
    rest = np.sqrt(np.maximum((y[:, upto:] ** 2).sum(1), 0))
    return np.hstack([y[:, :upto], rest[:, None]])


def tile_pairs(ya: np.ndarray, yb: np.ndarray, xa: np.ndarray, xb: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (row of a, row of b), tile by tile; of one set with itself, each pair once."""
    d = ya.shape[1]
    steps = [min(k, d) for k in range(STEP, d + STEP, STEP)]
    tails = {k: (np.linalg.norm(ya[:, k:], axis=1), np.linalg.norm(yb[:, k:], axis=1)) for k in steps}
    ea, eb = _extended(ya, steps[0]), _extended(yb, steps[0])
    for p in range(0, len(ya), TILE):
        for q in range(p if same else 0, len(yb), TILE):
            bound = ea[p : p + TILE] @ eb[q : q + TILE].T
            i, j = np.nonzero(bound >= threshold - SLACK)
            i, j = i + p, j + q
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 18):
                a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                part = np.einsum("ij,ij->i", ya[a, : steps[0]], yb[b, : steps[0]])
                for before, k in zip(steps, steps[1:]):
                    part += np.einsum("ij,ij->i", ya[a, before:k], yb[b, before:k])
                    on = part + tails[k][0][a] * tails[k][1][b] >= threshold - SLACK
                    a, b, part = a[on], b[on], part[on]
                on = np.einsum("ij,ij->i", xa[a], xb[b]) >= threshold
                if on.any():
                    yield a[on], b[on]


def linked_vectors(nodes: DataFrame, d: int, n: int, wire: str, threshold: float, leaf_rows: int | None) -> DataFrame:
    """(node, links, partner) for the linked ones of ``nodes`` (node, copies, x), vectors of one length."""
    spark = nodes.sparkSession
    most = leaf_rows or max(256, LEAF // d)
    axes = principal_axes(nodes, d, wire)
    k = min(LEADING, d)
    leaves = min(LEAVES, 1 << max(0, -(-n // most) - 1).bit_length())
    sample = nodes.select("x").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow()
    tree = Tree(_unit(_matrix(sample.column("x"), d, wire)) @ axes[:, :k], leaves.bit_length() - 1)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, rows = np.full((leaves, k), np.inf), np.full((leaves, k), -np.inf), np.zeros(leaves, np.int64)
        for b in batches:
            y = _unit(_matrix(b.column(0), d, wire)) @ axes[:, :k]
            leaf = tree.leaf(y)
            np.minimum.at(low, leaf, y)
            np.maximum.at(high, leaf, y)
            rows += np.bincount(leaf, minlength=leaves)
        on = np.flatnonzero(rows)
        columns = [on.tolist(), rows[on].tolist(), low[on].tolist(), high[on].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["leaf", "n", "low", "high"])

    each = [F.struct(F.min(F.col("low")[i]).alias("low"), F.max(F.col("high")[i]).alias("high")) for i in range(k)]
    found = nodes.select("x").mapInArrow(boxes, "leaf long, n long, low array<double>, high array<double>").groupBy("leaf").agg(F.sum("n").alias("n"), F.array(*each).alias("box")).collect()
    low, high, chunks = np.full((leaves, k), np.inf), np.full((leaves, k), -np.inf), np.ones(leaves, np.int64)
    for r in found:
        low[r["leaf"]], high[r["leaf"]], chunks[r["leaf"]] = [x["low"] for x in r["box"]], [x["high"] for x in r["box"]], -(-r["n"] // most)
    first = np.cumsum(chunks) - chunks  # number of each leaf's first chunk
    shared = spark.sparkContext.broadcast((axes, tree, Boxes(low, high), chunks, first))
    reach = 2 - 2 * threshold + SLACK
    rows_at_once = max(16, 400_000 // int(chunks.sum()))
    node_type = nodes.select("node").limit(0).toArrow().schema.field("node").type
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(node_type), pa.list_(pa.int64()), pa.binary()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, tree, boxes, chunks, first = shared.value
        for b in (whole.slice(at, rows_at_once) for whole in batches for at in range(0, whole.num_rows, rows_at_once)):
            raw = b.column(2).to_pylist()
            y = _unit(_matrix(b.column(2), d, wire)) @ axes[:, :k]
            home = tree.leaf(y)
            salt = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "little") for x in raw], np.int64)
            mine = first[home] + salt % chunks[home]
            row, leaf = boxes.reached(y, reach)
            row, leaf = np.repeat(row, chunks[leaf]), np.repeat(leaf, chunks[leaf])
            if not len(row):
                continue
            run = np.concatenate([[True], (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])])
            other = first[leaf] + np.arange(len(row)) - np.maximum.accumulate(np.where(run, np.arange(len(row)), 0))
            order = np.lexsort((row, other, mine[row]))
            row, other = row[order], other[order]
            edge = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (mine[row][1:] != mine[row][:-1]), [True]]))
            out = []
            for s, e in zip(edge, edge[1:]):
                pick, m, o = row[s:e], int(mine[row[s]]), int(other[s])
                at = pa.array(pick)
                out.append((min(m, o), max(m, o), m, b.column(0).take(at).to_pylist(), b.column(1).take(at).to_pylist(), b"".join(raw[i] for i in pick)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["a", "b", "mine", "nodes", "copies", "x"])

    def compare(key, table):
        a, b = (v.as_py() for v in key)
        side = {}
        for leaf in {a, b}:
            part = table.filter(pa.compute.equal(table.column("mine"), leaf))
            names = [r for col in part.column("nodes").to_pylist() for r in col]
            copies = np.array([c for col in part.column("copies").to_pylist() for c in col], np.int64)
            x = _matrix(part.column("x"), d, wire)
            side[leaf] = (names, copies, _unit(x) if len(x) else x)
        axes = shared.value[0]
        (ra, ca, xa), (rb, cb, xb) = side[a], side[b]
        shift = 0 if a == b else len(ra)
        names, copies = (ra, ca) if a == b else (ra + rb, np.concatenate([ca, cb]))
        number, label = np.zeros(len(names), np.int64), np.arange(len(names))
        if len(xa) and len(xb):
            for i, j in tile_pairs(xa @ axes, xb @ axes, xa, xb, a == b, threshold):
                np.add.at(number, i, copies[j + shift])
                np.add.at(number, j + shift, copies[i])
                label = _merge_labels(label, i, j + shift)
        on = np.flatnonzero(number)
        return pa.table([pa.array([names[i] for i in on], node_type), pa.array(number[on]), pa.array([names[i] for i in label[on]], node_type)], names=["node", "links", "partner"])

    kind = nodes.schema["node"].dataType.simpleString()
    dealt = nodes.select("node", "copies", "x").mapInArrow(deal, f"a long, b long, mine long, nodes array<{kind}>, copies array<long>, x binary")
    return dealt.groupBy("a", "b").applyInArrow(compare, f"node {kind}, links long, partner {kind}")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, leaf_rows: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    rows, wire = keyed(vectors, id_col, vector_col)
    keys = materialise(rows.select("id", "key"), "vector-keys")
    nodes = rows.where("key is not null").groupBy("d", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x"))
    nodes = materialise(nodes.select("d", F.struct("rep", "key").alias("node"), "copies", "x"), "distinct-vectors")
    found = None
    for r in nodes.groupBy("d").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).collect():
        some = linked_vectors(nodes.where(F.col("d") == r["d"]), r["d"], r["n"], wire, threshold, leaf_rows)
        found = some if found is None else found.unionByName(some)
    if found is None:
        none = keys.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return none.withColumn("kept", F.col(id_col).isNotNull())
    found = materialise(found, "linked-vectors")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(components, "node", "left")
    known = materialise(
        nodes.select("node", "copies").join(linked, "node", "left").select(
            F.col("node.key").alias("key"), "copies",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component.rep", "node.rep").alias("component_id"),
        ),
        "known-vectors",
    )
    total = known.agg(F.sum("copies")).first()[0]
    out = join_counted(keys.where("key is not null"), known, "key", "copies", total).select("id", "n_links", "component_id")
    out = out.unionByName(keys.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
