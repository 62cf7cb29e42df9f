"""Chain models over reads of any length: a parallel scan over a semiring, by ranges of blocks.

What a range of blocks does to a chain is a matrix from the state before it to the state after it, in the log
semiring (sums over paths) or the max-plus one (best paths). Matrices of ranges are multiplied in a tree, FAN
at a time, so a read is decoded by as many tasks as it has ranges, and no row ever holds more than RANGE_BLOCKS
blocks or FAN matrices. That is all that partitions and scores need. Posteriors and paths go down the tree
again: a node hands its children the log sums before and after them, or the states in which they begin and end,
and at last each range works its own blocks out from these.

The sweep up writes each level once, 64 numbers for a range of a hundred blocks at eight states; the sweep down
joins it by (read_id, node). The number of levels comes from the largest ``blk``, one number. Short reads
have one range and cost the same as ``chain``'s folds.

Results are those of ``chain``: blocks are (read_id, blk, w), ``blk`` counts from 0 without gaps; sums are added
in another order and differ in the last digits; of equally good paths another may be found. A read without
blocks has no rows, an empty table none at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.operators.chain import Topology
from strandspark.session import materialise, ship

RANGE_BLOCKS, FAN = 128, 32


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials; of nothing but minus infinity it is minus infinity."""
    top = x.max(axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis))


def _best(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis)


def transfer(w: np.ndarray, lengths: np.ndarray, t: Topology, add: Callable) -> np.ndarray:
    """(ranges, states, states): each range's matrix; ``w`` is (ranges, blocks, weights), padded beyond ``lengths``."""
    src, row, real = t.tables()
    n = t.n_state
    m = np.full((len(w), n, n), -np.inf)
    m[:, range(n), range(n)] = 0.0
    for k in range(w.shape[1]):
        on = lengths > k
        steps = np.where(real, m[on][:, :, src] + w[on, k][:, None, row], -np.inf)
        m[on] = add(steps, 3)
    return m


def product(a: np.ndarray, b: np.ndarray, add: Callable) -> np.ndarray:
    """Matrices (..., states, states) one after the other."""
    return add(a[..., :, :, None] + b[..., None, :, :], -2)


def step_matrices(w: np.ndarray, t: Topology) -> np.ndarray:
    """(blocks, states, states): the weight of the step between two states, minus infinity where there is none."""
    src, row, real = t.tables()
    to = np.broadcast_to(np.arange(t.n_state)[:, None], src.shape)
    m = np.full((len(w), t.n_state, t.n_state), -np.inf)
    m[:, src[real], to[real]] = w[:, row[real]]
    return m


def best_between(matrices: np.ndarray, first: int, last: int) -> np.ndarray:
    """States before, between and after matrices along the best way from state ``first`` to ``last``."""
    score = np.full(matrices.shape[1], -np.inf)
    score[first] = 0.0
    back = []
    for m in matrices:
        options = score[:, None] + m
        back.append(options.argmax(0))
        score = options.max(0)
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


# Spark operators


def _batched(rows: DataFrame, schema: str, f: Callable[[dict], Iterator[dict]], size: int = 64) -> DataFrame:
    """``f`` over rows as dicts, ``size`` rows of columns at a time."""
    ship(rows.sparkSession)
    out = rows.sparkSession.createDataFrame([], schema).schema
    kinds = {x.name: x.type for x in rows.sparkSession.createDataFrame([], out).toArrow().schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, size) for whole in batches for k in range(0, whole.num_rows, size)):
            for columns in f({n: b.column(i) for i, n in enumerate(b.schema.names)}):
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in kinds.items()], names=list(kinds))

    return rows.mapInArrow(run, out)


def _kind(df: DataFrame) -> str:
    return df.schema["read_id"].dataType.simpleString()


def block_ranges(blocks: DataFrame, size: int) -> DataFrame:
    """(read_id, node, ws): the weights of blocks ``node * size`` and on, in order, ``size`` of them at most."""
    pairs = F.array_sort(F.collect_list(F.struct("blk", F.col("w").cast("array<double>").alias("w"))))
    node = F.expr(f"cast(blk as bigint) div {size}").alias("node")
    return blocks.groupBy("read_id", node).agg(F.transform(pairs, lambda p: p["w"]).alias("ws"))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, longest, weights) of a list of lists column, and each row's length."""
    lengths = np.array(column.value_lengths().to_pylist())
    inner = column.flatten()
    flat = np.asarray(inner.flatten()).reshape(len(inner), -1)
    out = np.zeros((len(lengths), lengths.max(), flat.shape[1]))
    out[np.arange(lengths.max()) < lengths[:, None]] = flat
    return out, lengths


def _square(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), n, n)


def _ranges_up(ranges: DataFrame, t: Topology, add: Callable) -> DataFrame:
    def f(x: dict):
        m = transfer(*_padded(x["ws"]), t, add)
        yield {"read_id": x["read_id"], "node": x["node"], "m": list(m.reshape(len(m), -1))}

    return _batched(ranges, f"read_id {_kind(ranges)}, node long, m array<double>", f)


def _grouped(level: DataFrame, fan: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, node, nodes, ms): a node's children, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("node").alias("child"), "m")))
    grouped = level.groupBy("read_id", F.expr(f"node div {fan}").alias("node")).agg(pairs.alias("pairs"))
    return grouped.select("read_id", "node", F.transform("pairs", lambda p: p["child"]).alias("nodes"), F.transform("pairs", lambda p: p["m"]).alias("ms"))


def _level_up(level: DataFrame, t: Topology, add: Callable, fan: int) -> DataFrame:
    n = t.n_state

    def f(x: dict):
        m, lengths = _padded(x["ms"])
        m = m.reshape(*m.shape[:2], n, n)
        out = m[:, 0].copy()
        for k in range(1, m.shape[1]):
            on = lengths > k
            out[on] = product(out[on], m[on, k], add)
        yield {"read_id": x["read_id"], "node": x["node"], "m": list(out.reshape(len(out), -1))}

    return _batched(_grouped(level, fan), f"read_id {_kind(level)}, node long, m array<double>", f)


def sweep_up(blocks: DataFrame, t: Topology, add: Callable, size: int, fan: int, keep: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The ranges, and the levels of the tree from the ranges' matrices to one for each read; ``keep`` writes each level."""
    ranges = block_ranges(blocks, size)
    if keep:
        ranges = materialise(ranges, "scan-ranges")
    last = blocks.agg(F.max("blk")).first()[0] or 0
    levels = [_ranges_up(ranges, t, add)]
    nodes = int(last) // size
    while True:
        if keep:
            levels[-1] = materialise(levels[-1], "scan-level")
        if not nodes:
            return ranges, levels
        levels.append(_level_up(levels[-1], t, add, fan))
        nodes //= fan


def partition_by_ranges(blocks: DataFrame, t: Topology, size: int = RANGE_BLOCKS, fan: int = FAN) -> DataFrame:
    """(read_id, log_z) as ``chain.log_partitions`` has it."""
    _, levels = sweep_up(blocks, t, _sum, size, fan)

    def f(x: dict):
        yield {"read_id": x["read_id"], "log_z": _sum(np.asarray(x["m"].flatten()).reshape(len(x["m"]), -1), 1)}

    return _batched(levels[-1], f"read_id {_kind(blocks)}, log_z double", f, 4096)


def score_by_ranges(blocks: DataFrame, t: Topology, size: int = RANGE_BLOCKS, fan: int = FAN) -> DataFrame:
    """(read_id, score) as ``chain.viterbi_scores`` has it."""
    _, levels = sweep_up(blocks, t, _best, size, fan)
    return levels[-1].select("read_id", F.array_max("m").alias("score"))


def _down(parents: DataFrame, level: DataFrame, fan: int, schema: str, f: Callable) -> DataFrame:
    """What ``f`` hands from each parent to its children in ``level``."""
    return materialise(_batched(_grouped(level, fan).join(parents, ["read_id", "node"]), schema, f), "scan-down")


def sums_around(blocks: DataFrame, t: Topology, size: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The ranges, and (read_id, node, f, b): log sums of all paths up to each range's beginning and from its end on."""
    ranges, levels = sweep_up(blocks, t, _sum, size, fan, keep=True)
    n = t.n_state
    zero = F.array(*[F.lit(0.0)] * n)
    now = levels[-1].select("read_id", "node", zero.alias("f"), zero.alias("b"))

    def f(x: dict):
        out = {"read_id": [], "node": [], "f": [], "b": []}
        for read, nodes, ms, f0, b0 in zip(*(x[k].to_pylist() for k in ("read_id", "nodes", "ms", "f", "b"))):
            m = np.array(ms).reshape(-1, n, n)
            before, after = [np.array(f0)], [np.array(b0)]
            for k in range(len(m) - 1):
                before.append(_sum(before[-1][:, None] + m[k], 0))
                after.append(_sum(m[len(m) - 1 - k] + after[-1][None, :], 1))
            out["read_id"] += [read] * len(m)
            out["node"] += nodes
            out["f"] += before
            out["b"] += after[::-1]
        yield out

    for level in levels[-2::-1]:
        now = _down(now, level, fan, f"read_id {_kind(blocks)}, node long, f array<double>, b array<double>", f)
    return ranges, now


def posteriors_by_ranges(blocks: DataFrame, t: Topology, normalised: bool = True, size: int = RANGE_BLOCKS, fan: int = FAN) -> DataFrame:
    """(read_id, blk, w) as ``chain.posteriors`` has it."""
    src, row, real = t.tables()
    to = np.broadcast_to(np.arange(t.n_state)[:, None], src.shape)
    used, place = np.unique(row[real], return_inverse=True)

    def one(w: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = step_matrices(w, t)
        before, after = [f], [b]
        for k in range(len(w)):
            before.append(_sum(before[-1][:, None] + m[k], 0))
            after.append(_sum(m[len(w) - 1 - k] + after[-1][None, :], 1))
        before, after = np.array(before[:-1]), np.array(after[-2::-1])
        steps = before[:, src[real]] + w[:, row[real]] + after[:, to[real]]
        rows = np.stack([_sum(steps[:, place == k], 1) for k in range(len(used))], 1)
        out = w.copy()
        out[:, used] = rows - (_sum(rows, 1)[:, None] if normalised else 0.0)
        return out

    def f(x: dict):
        for read, node, ws, f0, b0 in zip(*(x[k].to_pylist() for k in ("read_id", "node", "ws", "f", "b"))):
            w = np.array(ws, float)
            yield {"read_id": [read] * len(w), "blk": np.arange(len(w)) + node * size, "w": list(one(w, np.array(f0), np.array(b0)))}

    ranges, around = sums_around(blocks, t, size, fan)
    return _batched(ranges.join(around, ["read_id", "node"]), f"read_id {_kind(blocks)}, blk long, w array<double>", f)


def decode_by_ranges(blocks: DataFrame, t: Topology, size: int = RANGE_BLOCKS, fan: int = FAN) -> DataFrame:
    """(read_id, pos, state, q, score) as ``chain.decode`` has it.

    A node knows the states that its best way begins and ends in, and finds those between its children.
    """
    n = t.n_state
    ranges, levels = sweep_up(blocks, t, _best, size, fan, keep=True)
    ends = F.array_position("m", F.array_max("m")).cast("int") - 1
    now = levels[-1].select("read_id", "node", F.floor(ends / n).cast("int").alias("first"), (ends % n).alias("last"), F.array_max("m").alias("score"))

    def between(x: dict):
        out = {k: [] for k in ("read_id", "node", "first", "last", "score")}
        for read, nodes, ms, first, last, score in zip(*(x[k].to_pylist() for k in ("read_id", "nodes", "ms", "first", "last", "score"))):
            path = best_between(np.array(ms).reshape(-1, n, n), first, last).tolist()
            for k, v in (("read_id", [read] * len(nodes)), ("node", nodes), ("first", path[:-1]), ("last", path[1:]), ("score", [score] * len(nodes))):
                out[k] += v
        yield out

    def blocks_of(x: dict):
        for read, node, ws, first, last, score in zip(*(x[k].to_pylist() for k in ("read_id", "node", "ws", "first", "last", "score"))):
            m = step_matrices(np.array(ws, float), t)
            path = best_between(m, first, last)
            q = m[np.arange(len(m)), path[:-1], path[1:]].tolist()
            own = {"pos": np.arange(1, len(path)) + node * size, "state": path[1:], "q": q}
            if node == 0:
                own = {"pos": np.arange(len(path)), "state": path, "q": [None, *q]}
            yield {"read_id": [read] * len(own["pos"]), **own, "score": [score] * len(own["pos"])}

    for level in levels[-2::-1]:
        now = _down(now, level, fan, f"read_id {_kind(blocks)}, node long, first int, last int, score double", between)
    return _batched(ranges.join(now, ["read_id", "node"]), f"read_id {_kind(blocks)}, pos long, state long, q double, score double", blocks_of)
