"""Network layers on one read's (blocks, features) array, composed by a model's list of layers.

Reads are independent: a model runs as one Arrow stage over read-per-row batches with broadcast
weights. Affine maps of all blocks are one product each; only the recurrences loop. The stateless
layers alone, over tables of blocks, stand below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.operators import chain
from strandspark.functions.arrays import softmax as softmax_of
from strandspark.session import ship


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0)


ACTIVATIONS = {
    "none": lambda x: x, "tanh": np.tanh, "exp": np.exp, "swish": lambda x: x * _sigmoid(x),
    "elu": lambda x: np.where(x >= 0, x, np.expm1(np.minimum(x, 0))), "relu": lambda x: np.maximum(x, 0),
}


def convolution(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int) -> np.ndarray:
    """Zero-padded filters ``w`` (width, features in, features out) at every ``stride``-th of (..., blocks, features)."""
    width = len(w)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 2) + [((width - 1) // 2, width // 2), (0, 0)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width, axis=-2)[..., ::stride, :, :]  # blocks, features, width
    return np.tensordot(views, w, ([-1, -2], [0, 1])) + b


def affine(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ w + b


def softmax(x: np.ndarray, w: np.ndarray, b: np.ndarray, temp_weight: float = 1.0, temp_bias: float = 1.0) -> np.ndarray:
    z = ((x * (temp_bias / temp_weight)) @ w + b) / temp_bias
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gru(x: np.ndarray, s: np.ndarray, s2: np.ndarray | None = None, candidate: str = "tanh", lengths: np.ndarray | None = None) -> np.ndarray:
    """Gated recurrence over projected input (update, reset, candidate), of one read or of reads longest first.

    With ``s2`` the reset gate scales the state before its product; without, ``s`` has all three
    products and the gate scales the candidate's.
    """
    if x.ndim == 2:
        return gru(x[None], s, s2, candidate)[0]
    n, blocks, size = x.shape[0], x.shape[1], x.shape[2] // 3
    lengths = np.full(n, blocks) if lengths is None else lengths
    h, out, act = np.zeros((n, size)), np.zeros((n, blocks, size)), ACTIVATIONS[candidate]
    for k in range(blocks):
        m = chain._active(lengths, k)
        row, now = x[:m, k], h[:m]
        if s2 is None:
            p = now @ s
            z, r = _sigmoid(row[:, :size] + p[:, :size]), _sigmoid(row[:, size : 2 * size] + p[:, size : 2 * size])
            new = act(row[:, 2 * size :] + r * p[:, 2 * size :])
        else:
            g = _sigmoid(row[:, : 2 * size] + now @ s)
            z, r = g[:, :size], g[:, size:]
            new = act(row[:, 2 * size :] + (r * now) @ s2)
        h[:m] = out[:m, k] = z * now + (1 - z) * new
    return out


def lstm(x: np.ndarray, s: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Long short-term memory over projected input (input, forget, candidate, output), without peepholes."""
    if x.ndim == 2:
        return lstm(x[None], s)[0]
    n, blocks, size = x.shape[0], x.shape[1], x.shape[2] // 4
    lengths = np.full(n, blocks) if lengths is None else lengths
    h, c, out = np.zeros((n, size)), np.zeros((n, size)), np.zeros((n, blocks, size))
    for k in range(blocks):
        m = chain._active(lengths, k)
        i, f, g, o = np.split(x[:m, k] + h[:m] @ s, 4, axis=1)
        c[:m] = _sigmoid(f) * c[:m] + _sigmoid(i) * np.tanh(g)
        h[:m] = out[:m, k] = _sigmoid(o) * np.tanh(c[:m])
    return out


def head(x: np.ndarray, kind: str, n_base: int, temperature: float, lengths: np.ndarray) -> np.ndarray:
    """Globally normalised weights: each block of a read gives up its share of the log partition."""
    t = {"flip_flop": chain.flip_flop, "run_length": chain.run_length, "run_length_v1": chain.run_length_v1}[kind](n_base)
    out = np.empty(x.shape)
    own = 0 if kind == "flip_flop" else 2 * n_base
    out[..., own:] = 5 * np.tanh(x[..., own:]) / temperature
    if own:
        least = 0.1 if kind == "run_length_v1" else 1e-8
        out[..., :n_base] = 1 + _softplus(x[..., :n_base])
        out[..., n_base:own] = least + _softplus(x[..., n_base:own])
    last = chain.forward_backward_batch(out, lengths, t, backward=False)[0][:, -1]
    out[..., own:] -= (chain._lse(last, 1) / lengths)[:, None, None]
    return out


# A model is a list of layers: ("conv", stride, activation) | (recurrence, backward?, residual?) | ("head", kind).
_FIVE = [True, False, True, False, True]


def _recurrent(kind: str, residual: bool = False) -> list[tuple]:
    return [(kind, back, residual) for back in _FIVE]


NETWORKS: dict[str, list[tuple]] = {
    "flip_flop5": [("conv", 1, "swish"), ("conv", 1, "swish"), ("conv", 5, "swish"), *_recurrent("lstm"), ("head", "flip_flop")],
    "flip_flop": [("conv", 2, "tanh"), *_recurrent("gru_mod"), ("head", "flip_flop")],
    "run_length5": [("conv", 1, "swish"), ("conv", 1, "swish"), ("conv", 5, "swish"), *_recurrent("lstm"), ("head", "run_length")],
    "flip_flop_gru": [("conv", 2, "elu"), *_recurrent("gru", True), ("head", "flip_flop")],
    "flip_flop_relu": [("conv", 2, "elu"), *_recurrent("gru_relu", True), ("head", "flip_flop")],
    "run_length_v1": [("conv", 2, "tanh"), *_recurrent("gru_mod"), ("head", "run_length_v1")],
    "run_length": [("conv", 2, "tanh"), *_recurrent("lstm"), ("head", "run_length")],
}
GATES = {"lstm": 4, "gru": 3, "gru_mod": 3, "gru_relu": 3}

# Model names that callers use, the network of each and what it was trained on.
MODELS: dict[str, tuple[str, int, str]] = {
    "r941_native": ("flip_flop5", 4, "R9.4.1, native DNA"),
    "r941_rna002": ("flip_flop5", 4, "R9.4.1, direct RNA"),
    "r941_5mC": ("flip_flop", 5, "R9.4.1, native DNA with 5mC"),
    "r103_native": ("flip_flop5", 4, "R10.3, native DNA"),
    "rle_r941_native": ("run_length5", 4, "R9.4.1, native DNA, run lengths"),
}


def family(network: str) -> str:
    return NETWORKS[network][-1][1]


def model_table(spark) -> DataFrame:
    """(model, family, n_base, description): what may be asked for."""
    return spark.createDataFrame([(m, family(n), b, d) for m, (n, b, d) in MODELS.items()], "model string, family string, n_base int, description string")


def synthetic_weights(network: str, n_base: int, size: int = 16, width: int = 5, seed: int = 0) -> list[dict[str, np.ndarray]]:
    """Random weights of a network's shapes, for tests and where no trained ones are at hand."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(max(1, shape[0])), shape)
    out, features = [], 1
    for layer in NETWORKS[network]:
        if layer[0] == "conv":
            out.append({"w": draw(width, features, size), "b": draw(size)})
        elif layer[0] == "head":
            n = (4 if layer[1] == "run_length_v1" else 2 * (n_base + 1)) * n_base
            out.append({"w": draw(features, n), "b": draw(n)})
        else:
            g = GATES[layer[0]]
            own = {"w": draw(features, g * size), "b": draw(g * size), "s": draw(size, (2 if layer[0] in ("gru", "gru_relu") else g) * size)}
            out.append(own | ({"s2": draw(size, size)} if layer[0] in ("gru", "gru_relu") else {}))
        features = size
    return out


def run_batch(signals: list[np.ndarray], network: str, weights: list[dict[str, np.ndarray]], n_base: int, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (reads, blocks, weights) of normalised signals, the longest first, and each one's blocks.

    Reads are padded to the longest; a recurrence takes one step for all reads that still have a block.
    """
    lengths = np.array([len(x) for x in signals])
    x = np.zeros((len(signals), lengths[0], 1))
    for k, s in enumerate(signals):
        x[k, : len(s), 0] = s
    for layer, p in zip(NETWORKS[network], weights):
        if layer[0] == "conv":
            x = ACTIVATIONS[layer[2]](convolution(x, p["w"], p["b"], layer[1]))
            lengths = -(-lengths // layer[1])
            x[np.arange(x.shape[1]) >= lengths[:, None]] = 0.0
        elif layer[0] == "head":
            return head(affine(x, p["w"], p["b"]), layer[1], n_base, temperature, lengths), lengths
        else:
            kind, backward, residual = layer
            turned = np.where(np.arange(x.shape[1]) < lengths[:, None], lengths[:, None] - 1 - np.arange(x.shape[1]), np.arange(x.shape[1]))[..., None]
            y = affine(x, p["w"], p["b"])
            y = np.take_along_axis(y, turned, 1) if backward else y
            y = lstm(y, p["s"], lengths) if kind == "lstm" else gru(y, p["s"], p.get("s2"), "relu" if kind == "gru_relu" else "tanh", lengths)
            y = np.take_along_axis(y, turned, 1) if backward else y
            x = x + y if residual else y
    return x, lengths


def run_network(signal: np.ndarray, network: str, weights: list[dict[str, np.ndarray]], n_base: int, temperature: float = 1.0) -> np.ndarray:
    """(blocks, weights) of one read's normalised signal."""
    return run_batch([np.asarray(signal, float)], network, weights, n_base, temperature)[0][0]


#: Samples, padding included, and reads that are worked on together.
BATCH_SAMPLES, BATCH_READS = 400_000, 256


def in_batches(signals: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of signals that aren't empty in groups of like length, the longest first."""
    order = sorted((k for k, s in enumerate(signals) if len(s)), key=lambda k: -len(signals[k]))
    while order:
        n = max(1, min(BATCH_READS, BATCH_SAMPLES // len(signals[order[0]])))
        n = next((i for i in range(1, n) if i < len(order) and 2 * len(signals[order[i]]) < len(signals[order[0]])), n)
        yield order[:n]
        order = order[n:]


def transitions(reads: DataFrame, network: str, weights: list[dict[str, np.ndarray]], n_base: int, temperature: float = 1.0) -> DataFrame:
    """(read_id, blk, w) of reads (read_id, signal); reads without signal give no blocks."""
    ship(reads.sparkSession)
    shared = reads.sparkSession.sparkContext.broadcast(weights)
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, BATCH_READS) for whole in batches for k in range(0, whole.num_rows, BATCH_READS)):
            signals = [np.array(s or [], float) for s in b.column(1).to_pylist()]
            for some in in_batches(signals):
                w, lengths = run_batch([signals[k] for k in some], network, shared.value, n_base, temperature)
                for j, n in zip(some, lengths.tolist()):
                    own = w[some.index(j), :n]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[j].as_py()] * n, b.schema.field(0).type), pa.array(np.arange(n)), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["read_id", "blk", "w"])

    return reads.select("read_id", F.col("signal").cast("array<double>").alias("signal")).mapInArrow(run, f"read_id {kind}, blk long, w array<double>")


# layers over blocks' features (read_id, blk, w): arrays stay arrays, weights travel with the code, nothing is shuffled


def affine_blocks(blocks: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None, activation: str = "none") -> DataFrame:
    """(read_id, blk, w): features times ``weights`` (features, units), one product a batch of blocks; a block of nulls or of another width is null."""
    ship(blocks.sparkSession)
    m, c, act = np.asarray(weights, float), 0.0 if bias is None else np.asarray(bias, float), ACTIVATIONS[activation]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2)
            fit = np.array(rows.value_lengths().fill_null(-1)) == len(m)
            some = rows.filter(pa.array(fit))
            x = np.asarray(some.flatten(), float).reshape(len(some), len(m))
            y = act(x @ m + c)
            offsets = np.concatenate([[0], np.cumsum(np.where(fit, m.shape[1], 0))]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()), mask=pa.array(~fit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], names=["read_id", "blk", "w"])

    kinds = {n: blocks.schema[n].dataType.simpleString() for n in ("read_id", "blk")}
    return blocks.select("read_id", "blk", F.col("w").cast("array<double>").alias("w")).mapInArrow(run, f"read_id {kinds['read_id']}, blk {kinds['blk']}, w array<double>")


def softmax_blocks(blocks: DataFrame, weights: np.ndarray, bias: np.ndarray, temp_weight: float = 1.0, temp_bias: float = 1.0) -> DataFrame:
    """(read_id, blk, w): shares of a block's units; the temperatures divide weights and biases."""
    z = affine_blocks(blocks, np.asarray(weights, float) / temp_weight, np.asarray(bias, float) / temp_bias)
    return z.withColumn("w", softmax_of(F.col("w")))


def add_layers(blocks: DataFrame, other: DataFrame) -> DataFrame:
    """Residual connection of two layers of the same blocks."""
    o = other.withColumnRenamed("w", "other")
    return blocks.join(o, ["read_id", "blk"]).select("read_id", "blk", F.zip_with("w", "other", lambda x, y: x + y).alias("w"))


def gather_columns(index: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (..., key) with the table's vector for ``key``: an embedding."""
    return index.join(table, "key")
