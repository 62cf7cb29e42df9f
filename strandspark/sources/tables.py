"""Parquet tables that stand in for hierarchical files: traces and network weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_traces(traces: DataFrame, path: str, mode: str = "append", compression: str = "zstd", level: int | None = None) -> None:
    """(read_id, signal, trace) appended; ``level`` is the codec's where it has one."""
    writer = traces.select("read_id", "signal", "trace").write.mode(mode).option("compression", compression)
    if level is not None:
        writer = writer.option(f"parquet.compression.codec.{compression}.level", str(level))
    writer.parquet(path)


def trace_points(traces: DataFrame) -> DataFrame:
    """What a viewer plots: (read_id, pos, state, probability)."""
    blocks = traces.select("read_id", F.posexplode("trace").alias("pos", "shares"))
    return blocks.select("read_id", "pos", F.posexplode("shares").alias("state", "share")).withColumn("probability", F.col("share") / 255).drop("share")


def weights_table(spark: SparkSession, model: str, layers: list[dict[str, np.ndarray]]) -> DataFrame:
    """(model, layer, param, shape, data): a row each array, data in row-major order."""
    rows = [(model, k, name, [int(n) for n in a.shape], [float(x) for x in a.ravel()]) for k, layer in enumerate(layers) for name, a in layer.items()]
    return spark.createDataFrame(rows, "model string, layer int, param string, shape array<int>, data array<double>")


# layers as training frameworks keep them, in the shapes that networks here take


def recurrent_layer(inputs: np.ndarray, states: np.ndarray, bias: np.ndarray, kind: str) -> dict[str, np.ndarray]:
    """From (gates * size, features) with gates one after another: a GRU's reset, update, candidate; an LSTM's input, forget, candidate, output."""
    gates = [1, 0, 2] if kind.startswith("gru") else [0, 1, 2, 3]

    def turned(a: np.ndarray) -> np.ndarray:
        parts = np.split(a, len(gates))
        return np.concatenate([parts[g] for g in gates])

    own = {"w": turned(inputs).T, "b": turned(bias)}
    s = turned(states).T
    if kind in ("gru", "gru_relu"):
        size = s.shape[0]
        return own | {"s": s[:, : 2 * size], "s2": s[:, 2 * size :]}
    return own | {"s": s}


def convolution_layer(filters: np.ndarray, bias: np.ndarray, scale: float = 1.0) -> dict[str, np.ndarray]:
    """From (features out, features in, width); ``scale`` makes up for a signal that was scaled otherwise in training."""
    return {"w": filters.transpose(2, 1, 0) * scale, "b": bias}


def linear_layer(weights: np.ndarray, bias: np.ndarray) -> dict[str, np.ndarray]:
    """From (features out, features in)."""
    return {"w": weights.T, "b": bias}


def load_weights(table: DataFrame, model: str) -> list[dict[str, np.ndarray]]:
    """One model's layers on the driver; a model's size doesn't follow the data."""
    layers: dict[int, dict[str, np.ndarray]] = {}
    for r in table.where(F.col("model") == model).collect():
        layers.setdefault(r["layer"], {})[r["param"]] = np.array(r["data"]).reshape(r["shape"])
    if not layers:
        raise ValueError(f"no weights of model {model!r}")
    return [layers[k] for k in sorted(layers)]


def random_matrix(spark: SparkSession, nr: int, nc: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """(col, data): uniform columns."""
    values = F.array(*[F.rand(seed + k) * (high - low) + low for k in range(nr)])
    return spark.range(nc).select(F.col("id").cast("int").alias("col"), values.alias("data"))
