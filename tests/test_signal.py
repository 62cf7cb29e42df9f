import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.functions import arrays
from strandspark.operators import signal


def long_form(spark, reads):
    rows = [(k, i, float(v)) for k, values in reads.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "read_id string, idx long, value double")


def values(df, order="idx"):
    out = {}
    for r in df.orderBy("read_id", order).collect():
        out.setdefault(r["read_id"], []).append(r["value"])
    return out


def mad(x):
    return 1.4826 * np.median(np.abs(x - np.median(x)))


def test_median_of_odd_and_even(spark):
    found = signal.quantiles(long_form(spark, {"odd": range(5), "even": range(4)}), [0.5, 0.0, 1.0, 0.25])
    assert {r["read_id"]: tuple(r)[1:] for r in found.collect()} == {"odd": (2.0, 0.0, 4.0, 1.0), "even": (1.5, 0.0, 3.0, 0.75)}


def test_normalise_constant_single_and_nan(spark):
    s = long_form(spark, {"a": [1, 2, 3, 4, 10], "flat": [5, 5, 5], "one": [7], "nan": [1, 2, float("nan"), 4]})
    got = values(signal.normalise(s))
    assert np.allclose(got["a"], (np.array([1, 2, 3, 4, 10]) - 3) / mad(np.array([1, 2, 3, 4, 10.0])))
    assert got["flat"] == [None] * 3 and got["one"] == [0.0]
    assert got["nan"][0] == pytest.approx((1 - 2) / mad(np.array([1, 2, 4.0])))


def plain_trim(x, chunk, percent, head, tail):
    n = len(x) // chunk
    if not n:
        return None
    mads = np.array([mad(x[k * chunk : (k + 1) * chunk]) for k in range(n)])
    loud = np.flatnonzero(mads > np.quantile(mads, percent))
    if not len(loud):
        return None
    start, end = loud[0] * chunk, (loud[-1] + 1) * chunk
    start = start + head if len(x) - start > head else len(x)
    end = max(end - tail, 0)
    return None if start >= end else (start, end)


@pytest.mark.parametrize("chunk,percent,head,tail", [(10, 0.0, 0, 0), (10, 0.3, 12, 5), (7, 0.5, 3, 3), (10, 0.0, 500, 1)])
def test_trim_equals_plain_version(spark, chunk, percent, head, tail):
    rng = np.random.default_rng(chunk)
    reads = {f"r{k}": np.concatenate([rng.normal(0, 0.1, 20), rng.normal(0, 2, 60 + k), rng.normal(0, 0.1, 15)]) for k in range(4)}
    reads |= {"short": rng.normal(0, 1, chunk - 1), "flat": np.ones(50)}
    bounds = {r["read_id"]: r for r in signal.trim_bounds(long_form(spark, reads), chunk, percent, head, tail).collect()}
    for k, x in reads.items():
        want = plain_trim(x, chunk, percent, head, tail)
        got = bounds[k]
        assert (got["error"] is None) == (want is not None), k
        if want:
            assert (got["start"], got["end"]) == want
    assert bounds["short"]["error"] == "too_short"
    kept = values(signal.trim(long_form(spark, reads), chunk, percent, head, tail))
    assert {k: len(v) for k, v in kept.items()} == {k: w[1] - w[0] for k, x in reads.items() if (w := plain_trim(x, chunk, percent, head, tail))}


def test_simple_maps(spark):
    s = long_form(spark, {"a": [1, -5, 2, 8]})
    assert values(signal.difference(s))["a"] == [-6, 7, 6, 0]
    assert values(signal.clip(s, 4.0))["a"] == [1, -4, 2, 4]
    assert values(signal.replace_large(s, 4.0, 9.0))["a"] == [1, 9, 2, 9]
    x = np.array([1, -5, 2, 8.0])
    assert np.allclose(values(signal.studentise(s))["a"], (x - x.mean()) / x.std())
    assert np.allclose(values(signal.scale_to_pa(s, 16.0, 1373.41, 8192.0))["a"], (x + 16) * 1373.41 / 8192)
    assert np.allclose(values(signal.shift_scale(s, F.lit(1.0), F.lit(2.0)))["a"], (x - 1) / 2)


CONVOLUTIONS = {
    (1,): [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    (1, 1): [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 10],
    (1, 1, 1): [1, 3, 6, 9, 12, 15, 18, 21, 24, 27, 19],
    (1, 1, 1, 1): [3, 6, 10, 14, 18, 22, 26, 30, 34, 27, 19],
    (1, 1, 1, 1, 1): [3, 6, 10, 15, 20, 25, 30, 35, 40, 34, 27],
    (-1, 0, 1): [1, 2, 2, 2, 2, 2, 2, 2, 2, 2, -9],
}


@pytest.mark.parametrize("taps", CONVOLUTIONS)
def test_convolutions(spark, taps):
    s = long_form(spark, {"a": range(11)})
    assert values(signal.convolve(s, list(taps)), "pos")["a"] == CONVOLUTIONS[taps]


@pytest.mark.parametrize("stride,want", [(2, [0, 2, 4, 6, 8, 10]), (3, [0, 3, 6, 9]), (4, [0, 4, 8]), (5, [0, 5, 10])])
def test_strides(spark, stride, want):
    assert values(signal.convolve(long_form(spark, {"a": range(11)}), [1.0], stride), "pos")["a"] == want


def test_reads_and_samples(spark):
    s = long_form(spark, {"a": [3, 1, 2], "b": [9]})
    reads = signal.to_reads(s)
    assert {r["read_id"]: r["signal"] for r in reads.collect()} == {"a": [3, 1, 2], "b": [9]}
    assert values(signal.to_samples(reads)) == values(s)


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, -1.0, 3.0, 0.5],), ([],), ([2.0],)], "a array<double>")
    a = F.col("a")
    rows = df.select(
        arrays.arg_max(a).alias("hi"), arrays.arg_min(a).alias("lo"), arrays.changes(a).alias("n"), arrays.difference(a, 0.0).alias("d"), arrays.clip(a, 1.0).alias("c"),
        arrays.replace_large(a, 2.5).alias("f"), arrays.normalise(a).alias("s"), arrays.softmax(a).alias("e"), arrays.is_valid(a, -1.0, 3.0).alias("ok"), arrays.live_slice(a, F.lit(1), F.lit(3)).alias("l"),
    ).collect()
    assert (rows[0]["hi"], rows[0]["lo"], rows[0]["n"]) == (0, 1, 3)
    assert rows[0]["d"] == [-4.0, 4.0, -2.5, 0.0] and rows[1]["d"] == [] and rows[2]["d"] == [0.0]
    assert rows[0]["c"] == [1.0, -1.0, 1.0, 0.5] and rows[0]["f"] == [0.0, -1.0, 0.0, 0.5]
    assert sum(rows[0]["e"]) == pytest.approx(1) and sum(rows[0]["s"]) == pytest.approx(1)
    assert rows[0]["ok"] and rows[1]["ok"] and rows[0]["l"] == [-1.0, 3.0]


@pytest.mark.parametrize("n", [8, 9, 10, 11])
def test_row_normalise_ones(spark, n):
    got = spark.createDataFrame([([1.0] * n,)], "a array<double>").select(arrays.normalise(F.col("a")).alias("a")).first()["a"]
    assert np.allclose(got, 1 / n, atol=1e-5)


def test_elu_literals(spark):
    from strandspark.functions.activations import elu

    x = [0.0, -0.0, 1.0, 2.0, 3.0, 4.0, -1.0, -2.0, -3.0, -4.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(elu(F.col("x"))).collect()]
    assert np.allclose(got, [0, 0, 1, 2, 3, 4, -0.6321206, -0.8646647, -0.9502129, -0.9816844], atol=1e-6)


def test_lgamma(spark):
    import math

    from strandspark.functions.distributions import lgamma

    x = [0.1, 0.5, 1.0, 1.5, 2.0, 10.0, 171.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(lgamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
