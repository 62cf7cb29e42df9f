"""Linear-chain models over ordered blocks: one description serves decoding, partition and posteriors.

A topology lists, for each state, the states it can be reached from and the weight of each step, in the
order that decides ties. Scores and partitions are native: a fold (``aggregate``) over a read's array
of blocks whose step is unrolled from the topology. Paths and posteriors need every step's table, so
they run in Arrow batches of reads; a read here is in one row, ``scan`` has those that are too long for that.

Blocks are (read_id, blk, w): ``w`` holds one block's weights, ``blk`` orders them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.session import ship


@dataclass(frozen=True)
class Topology:
    """``steps[to]``: (from, weight index) pairs, the preferred first; the first largest wins."""

    name: str
    steps: tuple[tuple[tuple[int, int], ...], ...]
    n_weight: int

    @property
    def n_state(self) -> int:
        return len(self.steps)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From and weight index of each step by (to, choice), padded, and which are real."""
        width = max(map(len, self.steps))
        src, row, real = (np.zeros((self.n_state, width), t) for t in (np.int64, np.int64, bool))
        for to, choices in enumerate(self.steps):
            for k, (s, r) in enumerate(choices):
                src[to, k], row[to, k], real[to, k] = s, r, True
        return src, row, real


def flip_flop(n_base: int) -> Topology:
    """Any state reaches a flip; a flop is reached from its flip or itself. A tie keeps a flop's stay, else the lowest state."""
    n = 2 * n_base
    flips = [tuple((s, b * n + s) for s in range(n)) for b in range(n_base)]
    flops = [((b + n_base, n_base * n + b + n_base), (b, n_base * n + b)) for b in range(n_base)]
    return Topology("flip_flop", (*flips, *flops), n * (n_base + 1))


def flip_flop_states(n_base: int) -> Topology:
    """The same steps with one weight a state, the one gone to; a flop's tie favours its flip."""
    n = 2 * n_base
    flips = [tuple((s, b) for s in range(n)) for b in range(n_base)]
    flops = [((b, b + n_base), (b + n_base, b + n_base)) for b in range(n_base)]
    return Topology("flip_flop_states", (*flips, *flops), n)


def run_move_index(n_base: int, from_base: int, from_stay: bool, to_base: int) -> int:
    """Weight of a step of the run model: a block of sources for each base gone to, after shapes and scales."""
    return 2 * n_base + to_base * 2 * n_base + from_base + (n_base if from_stay else 0)


def run_length(n_base: int) -> Topology:
    """A base is moved into from every other base's move or stay, and stayed in from its own."""
    at = run_move_index
    moves = [tuple((b2 + n_base * s, at(n_base, b2, bool(s), b)) for b2 in range(n_base) if b2 != b for s in (0, 1)) for b in range(n_base)]
    stays = [((b, at(n_base, b, False, b)), (b + n_base, at(n_base, b, True, b))) for b in range(n_base)]
    return Topology("run_length", (*moves, *stays), 2 * n_base * (n_base + 1))


def run_length_v1(n_base: int) -> Topology:
    """One state a base; a move has one weight whichever other base it comes from, and wins a tie with the stay."""
    states = [(*((s, 2 * n_base + b) for s in range(n_base) if s != b), (b, 3 * n_base + b)) for b in range(n_base)]
    return Topology("run_length_v1", tuple(states), 4 * n_base)


# native folds


def block_arrays(blocks: DataFrame) -> DataFrame:
    """(read_id, blocks): a read's weights in order."""
    pairs = F.array_sort(F.collect_list(F.struct("blk", "w")))
    return blocks.groupBy("read_id").agg(F.transform(pairs, lambda p: p["w"].cast("array<double>")).alias("blocks"))


def _fold(blocks: Column, t: Topology, join: Callable[[list[Column]], Column]) -> Column:
    start = F.array(*[F.lit(0.0)] * t.n_state)
    return F.aggregate(blocks, start, lambda s, w: F.array(*[join([s[f] + w[r] for f, r in choices]) for choices in t.steps]))


def _log_sum(x: list[Column]) -> Column:
    top = F.greatest(*x) if len(x) > 1 else x[0]
    return top + F.ln(reduce(lambda a, b: a + b, [F.exp(v - top) for v in x]))


def viterbi_scores(blocks: DataFrame, t: Topology) -> DataFrame:
    """(read_id, score) of the best path."""
    best = _fold(F.col("blocks"), t, lambda x: F.greatest(*x) if len(x) > 1 else x[0])
    return block_arrays(blocks).select("read_id", F.array_max(best).alias("score"))


def log_partitions(blocks: DataFrame, t: Topology) -> DataFrame:
    """(read_id, log_z): log of the sum over all paths, from any state to any state."""
    states = block_arrays(blocks).select("read_id", _fold(F.col("blocks"), t, _log_sum).alias("s"))
    return states.select("read_id", _log_sum([F.col("s")[k] for k in range(t.n_state)]).alias("log_z"))


# kernels on a batch of reads: weights (reads, blocks, weights), longest read first, and each one's blocks


def _active(lengths: np.ndarray, k: int) -> int:
    """How many of the reads, longest first, have a block ``k``."""
    return int(np.searchsorted(-lengths, -k, "left"))


def viterbi_batch(w: np.ndarray, lengths: np.ndarray, t: Topology) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores, states (one more than blocks) and the weights of steps, zero beyond a read's end."""
    src, row, real = t.tables()
    n, blocks = w.shape[:2]
    score, back = np.zeros((n, t.n_state)), np.zeros((blocks, n, t.n_state), np.int8)
    for k in range(blocks):
        m = _active(lengths, k)
        choices = np.where(real, score[:m][:, src] + w[:m, k][:, row], -np.inf)
        back[k, :m] = choices.argmax(2)
        score[:m] = choices.max(2)
    path, step, each = np.zeros((n, blocks + 1), np.int64), np.zeros((n, blocks)), np.arange(n)
    path[each, lengths] = score.argmax(1)
    for k in range(blocks - 1, -1, -1):
        m = _active(lengths, k)
        to = path[:m, k + 1]
        c = back[k, each[:m], to]
        path[:m, k], step[:m, k] = src[to, c], w[each[:m], k, row[to, c]]
    return score.max(1), path, step


def forward_backward_batch(w: np.ndarray, lengths: np.ndarray, t: Topology, backward: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums, one row more than blocks; a read's last forward row is repeated beyond its end."""
    src, row, real = t.tables()
    n, blocks = w.shape[:2]
    f, b = np.zeros((n, blocks + 1, t.n_state)), np.zeros((n, blocks + 1, t.n_state))
    for k in range(blocks):
        m = _active(lengths, k)
        f[:m, k + 1] = _lse(np.where(real, f[:m, k][:, src] + w[:m, k][:, row], -np.inf), 2)
        f[m:, k + 1] = f[m:, k]
    if backward:
        to = np.broadcast_to(np.arange(t.n_state)[:, None], src.shape)
        for k in range(blocks - 1, -1, -1):
            m = _active(lengths, k)
            dense = np.full((m, t.n_state, t.n_state), -np.inf)
            dense[:, src[real], to[real]] = w[:m, k][:, row[real]] + b[:m, k + 1][:, to[real]]
            b[:m, k] = _lse(dense, 2)
    return f, b


def step_posteriors_batch(w: np.ndarray, lengths: np.ndarray, t: Topology, normalised: bool = True) -> np.ndarray:
    """Log posterior of every weight's steps at each block; weights that belong to no step stay as they are."""
    src, row, real = t.tables()
    f, b = forward_backward_batch(w, lengths, t)
    to = np.broadcast_to(np.arange(t.n_state)[:, None], src.shape)
    steps = f[:, :-1][:, :, src[real]] + w[:, :, row[real]] + b[:, 1:][:, :, to[real]]
    used, place = np.unique(row[real], return_inverse=True)
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    top = np.maximum.reduceat(steps[:, :, order], first, axis=2)
    sums = np.add.reduceat(np.exp(steps[:, :, order] - top[:, :, place[order]]), first, axis=2)
    rows = top + np.log(sums)
    out = w.astype(float).copy()
    out[:, :, used] = rows - (_lse(rows, 2)[:, :, None] if normalised else 0.0)
    return out


# the same for one read's (blocks, weights) array


def _one(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(w, float)[None], np.array([len(w)])


def viterbi(w: np.ndarray, t: Topology) -> tuple[float, np.ndarray, np.ndarray]:
    """Best score, its states (one more than blocks) and the weight of each step."""
    score, path, step = viterbi_batch(*_one(w), t)
    return float(score[0]), path[0], step[0]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(w: np.ndarray, t: Topology) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums, one row more than blocks."""
    f, b = forward_backward_batch(*_one(w), t)
    return f[0], b[0]


def step_posteriors(w: np.ndarray, t: Topology, normalised: bool = True) -> np.ndarray:
    return step_posteriors_batch(*_one(w), t, normalised)[0]


def state_posteriors(w: np.ndarray, t: Topology, log: bool = True) -> np.ndarray:
    """Log posterior of each state before, between and after blocks; or probabilities that sum to one."""
    f, b = forward_backward(w, t)
    s = f + b
    return s if log else np.exp(s - _lse(s, 1)[:, None])


def trace(log_posteriors: np.ndarray, t: Topology) -> np.ndarray:
    """State shares times 255: where the first block's steps come from, then where each block's go to."""
    src, row, real = t.tables()
    p = np.exp(np.minimum(log_posteriors, 0.0))
    to = np.broadcast_to(np.arange(t.n_state)[:, None], src.shape)
    out = np.zeros((len(p) + 1, t.n_state))
    np.add.at(out[0], src[real], p[0][row[real]])
    for k in range(len(p)):
        np.add.at(out[k + 1], to[real], p[k][row[real]])
    return np.minimum(np.floor(255 * out + 0.5), 255).astype(np.int64)


def partition(w: np.ndarray, t: Topology) -> float:
    return float(_lse(forward_backward(w, t)[0][-1], 0))


# Spark operators around the kernels: arrays of whole reads, batches of like length stepped through together

#: Reads, and numbers of padded weights, of a batch.
BATCH_READS, BATCH_WEIGHTS = 64, 1 << 22


def _batches(w: list[np.ndarray], n_weight: int):
    """Places of reads that are padded together, longest first."""
    order = sorted(range(len(w)), key=lambda k: -len(w[k]))
    at = 0
    while at < len(order):
        size = min(BATCH_READS, max(1, BATCH_WEIGHTS // max(1, len(w[order[at]]) * n_weight)))
        yield order[at : at + size]
        at += size


def _per_read(blocks: DataFrame, schema: str, f: Callable[[np.ndarray, np.ndarray], Callable[[int, int], dict]]) -> DataFrame:
    """``f`` over padded weights and lengths of a batch gives a function of (read's place, its blocks) to columns."""
    ship(blocks.sparkSession)
    reads = block_arrays(blocks)
    out = blocks.sparkSession.createDataFrame([], f"read_id {blocks.schema['read_id'].dataType.simpleString()}, {schema}").schema
    kinds = {x.name: x.type for x in blocks.sparkSession.createDataFrame([], out).toArrow().schema}

    def run(batches):
        for b in batches:
            column = b.column(1)
            ws = []
            for k in range(b.num_rows):
                inner = column[k].values
                ws.append(np.asarray(inner.flatten()).reshape(len(inner), -1) if len(inner) else np.zeros((0, 1)))
            for some in _batches(ws, max(x.shape[1] for x in ws)):
                lengths = np.array([len(ws[k]) for k in some])
                w = np.zeros((len(some), lengths[0], ws[some[0]].shape[1]))
                for i, k in enumerate(some):
                    w[i, : lengths[i]] = ws[k]
                each = f(w, lengths)
                for i, k in enumerate(some):
                    columns = each(i, int(lengths[i]))
                    n = len(next(iter(columns.values())))
                    read = pa.array([b.column(0)[k].as_py()] * n, kinds["read_id"])
                    yield pa.RecordBatch.from_arrays([read, *(pa.array(columns[c], kinds[c]) for c in out.names[1:])], names=out.names)

    return reads.mapInArrow(run, out)


def decode(blocks: DataFrame, t: Topology, posterior: bool = False, normalised: bool = True) -> DataFrame:
    """(read_id, pos, state, q, score): the best path, ``q`` the weight of the step into ``pos`` (null at 0)."""

    def f(w, lengths):
        score, path, step = viterbi_batch(step_posteriors_batch(w, lengths, t, normalised) if posterior else w, lengths, t)
        return lambda i, n: {"pos": np.arange(n + 1), "state": path[i, : n + 1], "q": [None, *step[i, :n].tolist()], "score": np.full(n + 1, score[i])}

    return _per_read(blocks, "pos long, state long, q double, score double", f)


def posteriors(blocks: DataFrame, t: Topology, normalised: bool = True) -> DataFrame:
    """(read_id, blk, w): log posteriors in the place of weights."""

    def f(w, lengths):
        found = step_posteriors_batch(w, lengths, t, normalised)
        return lambda i, n: {"blk": np.arange(n), "w": list(found[i, :n])}

    return _per_read(blocks, "blk long, w array<double>", f)


def states(blocks: DataFrame, t: Topology, log: bool = True) -> DataFrame:
    """(read_id, pos, p): state posteriors."""

    def f(w, lengths):
        forward, backward = forward_backward_batch(w, lengths, t)
        s = forward + backward
        found = s if log else np.exp(s - _lse(s, 2)[:, :, None])
        return lambda i, n: {"pos": np.arange(n + 1), "p": list(found[i, : n + 1])}

    return _per_read(blocks, "pos long, p array<double>", f)


def traces(blocks: DataFrame, t: Topology, posterior: bool = True) -> DataFrame:
    """(read_id, pos, trace): state shares in 255ths."""

    def f(w, lengths):
        found = step_posteriors_batch(w, lengths, t) if posterior else w
        return lambda i, n: {"pos": np.arange(n + 1), "trace": list(trace(found[i, :n], t))}

    return _per_read(blocks, "pos long, trace array<long>", f)


def run_path(decoded: DataFrame, n_base: int) -> DataFrame:
    """States after each block only: the run model doesn't emit the state it begins in."""
    return decoded.where("pos > 0").withColumn("pos", F.col("pos") - 1)


def moves_v1(decoded: DataFrame) -> DataFrame:
    """Run model 1's path: the base where it moves, -1 where it stays."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("read_id").orderBy("pos"))
    return decoded.withColumn("before", before).where("pos > 0").select("read_id", (F.col("pos") - 1).alias("pos"), F.when(F.col("state") == F.col("before"), -1).otherwise(F.col("state")).alias("state"), "score")


def combine_stays(decoded: DataFrame, n_base: int) -> DataFrame:
    """Every flop becomes -1, so that flips are what is left of a path."""
    return decoded.withColumn("state", F.when(F.col("state") < n_base, F.col("state")).otherwise(F.lit(-1)))
