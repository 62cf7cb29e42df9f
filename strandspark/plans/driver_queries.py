"""Queries registered for the driver, each with the SQL that must give the same rows.

Floating-point results are rounded, and 0 added so that -0.0 can't differ from 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark import session
from strandspark.functions import activations as act
from strandspark.functions import arrays, quality
from strandspark.functions import distributions as dist
from strandspark.operators import chain, network, sequence, signal
from strandspark.plans import basecall, views
from strandspark.plans.views import PATH, RUN, SIGNAL, block_sql, table, v_block, v_path, v_run, v_signal
from strandspark.sources import tables
from strandspark.sources import text as text_format
from strandspark.streaming.reads import assemble_reads

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rs(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandspark.plans import scale_queries  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from strandspark.plans import scale_queries  # noqa: F401

    return dict(_sql)


# ---------------------------------------------------------------- signal

_MAD = """med AS (SELECT read_id, quantile_cont(value, 0.5) AS median FROM s GROUP BY read_id),
    mad AS (SELECT s.read_id, any_value(median) AS median, 1.4826 * quantile_cont(abs(value - median), 0.5) AS mad FROM s JOIN med USING (read_id) GROUP BY s.read_id)"""


@register(f"SELECT read_id, idx, {rs('(value + 16.0) * (1373.41 / 8192.0)')} AS value FROM {SIGNAL}")
def scale_pa(spark, d):
    return signal.scale_to_pa(v_signal(spark, d), 16.0, 1373.41, 8192.0).select("read_id", "idx", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, {', '.join(f'{rs(f"quantile_cont(value, {p})")} AS q{k}' for k, p in enumerate((0, 0.1, 0.25, 0.5, 0.9, 1)))} FROM {SIGNAL} GROUP BY read_id")
def quantiles(spark, d):
    found = signal.quantiles(v_signal(spark, d), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
    return found.select("read_id", *[r(F.col(f"q{k}")).alias(f"q{k}") for k in range(6)])


@register(f"WITH s AS {SIGNAL}, {_MAD} SELECT read_id, {rs('median')} AS median, {rs('mad')} AS mad FROM mad")
def mad(spark, d):
    return signal.median_mad(v_signal(spark, d), ["read_id"]).select("read_id", r(F.col("median")).alias("median"), r(F.col("mad")).alias("mad"))


@register(f"WITH s AS {SIGNAL}, {_MAD} SELECT read_id, idx, {rs('(value - median) / mad')} AS value FROM s JOIN mad USING (read_id)")
def medmad_normalise(spark, d):
    return signal.normalise(v_signal(spark, d)).select("read_id", "idx", r(F.col("value")).alias("value"))


def _trim_sql(chunk: int, percent: float, head: int, tail: int) -> str:
    return f"""s0 AS {SIGNAL}, n AS (SELECT read_id, count(*) AS n, count(*) // {chunk} AS chunks FROM s0 GROUP BY read_id),
    c AS (SELECT read_id, idx // {chunk} AS chunk, value FROM s0 JOIN n USING (read_id) WHERE idx < chunks * {chunk}),
    cm AS (SELECT read_id, chunk, quantile_cont(value, 0.5) AS median FROM c GROUP BY ALL),
    cd AS (SELECT read_id, chunk, 1.4826 * quantile_cont(abs(value - median), 0.5) AS mad FROM c JOIN cm USING (read_id, chunk) GROUP BY ALL),
    th AS (SELECT read_id, quantile_cont(mad, {percent}) AS threshold FROM cd GROUP BY read_id),
    loud AS (SELECT read_id, min(chunk) * {chunk} AS a, (max(chunk) + 1) * {chunk} AS b FROM cd JOIN th USING (read_id) WHERE mad > threshold GROUP BY read_id),
    bounds AS (SELECT read_id, n, (CASE WHEN n - coalesce(a, 0) > {head} THEN coalesce(a, 0) + {head} ELSE n END)::BIGINT AS start, greatest(coalesce(b, 0) - {tail}, 0)::BIGINT AS "end"
        FROM n LEFT JOIN loud USING (read_id))"""


@register(
    f"""WITH {_trim_sql(8, 0.25, 2, 1)} SELECT read_id, n, start, "end",
    CASE WHEN n < 8 THEN 'too_short' WHEN start >= "end" THEN 'trimmed_away' END AS error FROM bounds"""
)
def chunk_mad_trim(spark, d):
    return signal.trim_bounds(v_signal(spark, d), 8, 0.25, 2, 1)


_TRIMMED = f"""WITH {_trim_sql(8, 0.0, 2, 1)}, s AS (SELECT s0.* FROM s0 JOIN bounds USING (read_id) WHERE idx >= start AND idx < "end"), {_MAD}"""


@register(f"{_TRIMMED} SELECT read_id, idx, {rs('(value - median) / mad')} AS value FROM s JOIN mad USING (read_id)")
def trim_segment(spark, d):
    return basecall.prepare(v_signal(spark, d), (2, 1), (8, 0.0)).select("read_id", "idx", r(F.col("value")).alias("value"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Reads trimmed by chunk MAD and normalised."""
    return trim_segment(spark, d)


@register(f"SELECT read_id, idx, {rs('coalesce(lead(value) OVER (PARTITION BY read_id ORDER BY idx) - value, 0)')} AS value FROM {SIGNAL}")
def difference(spark, d):
    return signal.difference(v_signal(spark, d)).select("read_id", "idx", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, idx, {rs('(value - 40.0) / 12.5')} AS value FROM {SIGNAL}")
def shift_scale(spark, d):
    return signal.shift_scale(v_signal(spark, d), F.lit(40.0), F.lit(12.5)).select("read_id", "idx", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, idx, {rs('(value - avg(value) OVER (PARTITION BY read_id)) / stddev_pop(value) OVER (PARTITION BY read_id)')} AS value FROM {SIGNAL}")
def studentise(spark, d):
    return signal.studentise(v_signal(spark, d)).select("read_id", "idx", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, idx, {rs('greatest(-30.0, least(30.0, value))')} AS value FROM {SIGNAL}")
def clip(spark, d):
    return signal.clip(v_signal(spark, d), 30.0).select("read_id", "idx", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, idx, {rs('CASE WHEN abs(value) > 60 THEN -1.0 ELSE value END')} AS value FROM {SIGNAL}")
def filter_large(spark, d):
    return signal.replace_large(v_signal(spark, d), 60.0, -1.0).select("read_id", "idx", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, idx, {rs('CASE WHEN abs(value) > 50 THEN 0.0 ELSE value END')} AS value FROM {SIGNAL}")
def depop(spark, d):
    return signal.replace_large(v_signal(spark, d), 50.0).select("read_id", "idx", r(F.col("value")).alias("value"))


def _taps(width: int) -> list[str]:
    left = (width - 1) // 2
    w = "OVER (PARTITION BY read_id ORDER BY idx)"
    return [f"coalesce({'lag' if k < left else 'lead'}(value, {abs(k - left)}) {w}, 0)" for k in range(width)]


@register(f"SELECT read_id, idx // 2 AS pos, {', '.join(f'{rs(f"x[{k + 1}]")} AS x{k}' for k in range(4))} FROM (SELECT read_id, idx, [{', '.join(_taps(4))}] AS x FROM {SIGNAL}) WHERE idx % 2 = 0")
def window_stack(spark, d):
    return signal.window_stack(v_signal(spark, d), 4, 2).select("read_id", "pos", *[r(F.col("window")[k]).alias(f"x{k}") for k in range(4)])


def _conv_sql(taps: list[float], stride: int, bias: float) -> str:
    total = " + ".join(f"{t} * {x}" for t, x in zip(taps, _taps(len(taps))))
    return f"SELECT read_id, idx // {stride} AS pos, {rs('value')} AS value FROM (SELECT read_id, idx, {bias} + {total} AS value FROM {SIGNAL}) WHERE idx % {stride} = 0"


@register(_conv_sql([-1.0, 0.5, 1.0], 1, 0.0))
def conv1d(spark, d):
    return signal.convolve(v_signal(spark, d), [-1.0, 0.5, 1.0]).select("read_id", "pos", r(F.col("value")).alias("value"))


@register(_conv_sql([0.5, -1.0, 0.25, 1.0, 2.0], 3, 0.125))
def conv1d_stride(spark, d):
    return signal.convolve(v_signal(spark, d), [0.5, -1.0, 0.25, 1.0, 2.0], 3, 0.125).select("read_id", "pos", r(F.col("value")).alias("value"))


@register(f"SELECT read_id, count(*)::INT AS n, {rs('sum(value)', 4)} AS total FROM {SIGNAL} GROUP BY read_id")
def read_arrays(spark, d):
    reads = signal.to_reads(v_signal(spark, d))
    return reads.select("read_id", F.size("signal").alias("n"), r(arrays.total(F.col("signal")), 4).alias("total"))


# ---------------------------------------------------------------- blocks

_B = block_sql(64)


@register(f"SELECT read_id, blk, (list_position(w, list_max(w)) - 1)::INT AS at_max, (list_position(w, list_min(w)) - 1)::INT AS at_min, {rs('list_max(w)')} AS largest, {rs('list_min(w)')} AS smallest FROM {_B}")
def block_extrema(spark, d):
    return v_block(spark, d, 64).select("read_id", "blk", arrays.arg_max(F.col("w")).alias("at_max"), arrays.arg_min(F.col("w")).alias("at_min"), r(F.array_max("w")).alias("largest"), r(F.array_min("w")).alias("smallest"))


@register(f"SELECT read_id, blk AS pos, CASE WHEN i = len(w) - 1 THEN -1 ELSE i END AS state, {rs('m')} AS score FROM (SELECT *, list_max(w) AS m, (list_position(w, list_max(w)) - 1)::INT AS i FROM {_B})")
def argmax_decoder(spark, d):
    return sequence.argmax_path(v_block(spark, d, 64)).select("read_id", "pos", "state", r(F.col("score")).alias("score"))


@register(f"SELECT read_id, (row - 1)::INT AS row, arg_max(blk, x) AS blk FROM (SELECT read_id, blk, unnest(w) AS x, generate_subscripts(w, 1) AS row FROM {_B}) GROUP BY ALL")
def column_argmax(spark, d):
    rows = v_block(spark, d, 64).select("read_id", "blk", F.posexplode("w").alias("row", "x"))
    return rows.groupBy("read_id", "row").agg(F.max_by("blk", "x").alias("blk"))


def _each(df: DataFrame, x: Column, digits: int = 6) -> DataFrame:
    """Every element of an array, by its place."""
    return df.select("read_id", "blk", F.posexplode(x).alias("row", "x")).select("read_id", "blk", "row", r(F.col("x"), digits).alias("x"))


def _each_sql(x: str, source: str, digits: int = 6) -> str:
    return f"SELECT read_id, blk, (row - 1)::INT AS row, {rs('x', digits)} AS x FROM (SELECT read_id, blk, unnest(x) AS x, generate_subscripts(x, 1) AS row FROM (SELECT *, {x} AS x FROM {source}))"


_W = block_sql(64)
_Z = "(list_max(w) + ln(list_sum(list_transform(w, lambda v: exp(v - list_max(w))))))"


@register(_each_sql(f"list_transform(w, lambda v: exp(v - {_Z}))", _W))
def softmax_block(spark, d):
    return _each(v_block(spark, d, 64), arrays.softmax(F.col("w")))


@register(_each_sql(f"list_transform(w, lambda v: v - {_Z})", _W))
def log_row_normalise(spark, d):
    return _each(v_block(spark, d, 64), arrays.log_normalise(F.col("w")))


@register(_each_sql(f"list_transform(w, lambda v: abs(v) / list_sum(list_transform(w, lambda u: abs(u))))", _W))
def row_normalise(spark, d):
    return _each(v_block(spark, d, 64), arrays.normalise(F.transform("w", F.abs)))


@register(_each_sql(f"list_transform(list_zip(w, list_transform(w, lambda v: v * v)), lambda p: p[1] + p[2])", _W))
def residual(spark, d):
    return _each(v_block(spark, d, 64), arrays.add(F.col("w"), F.transform("w", lambda v: v * v)))


@register(f"SELECT read_id, blk, len(list_filter(w, lambda v: abs(v) > 0.5)) = 0 AS valid, len(list_filter(list_zip(w, list_transform(w, lambda v: v * 1.0001)), lambda p: abs(p[1] - p[2]) > 0.00003)) = 0 AS near FROM {_B}")
def validate_blocks(spark, d):
    return v_block(spark, d, 64).select("read_id", "blk", arrays.is_valid(F.col("w"), -0.5, 0.5).alias("valid"), arrays.nearly_equal(F.col("w"), F.transform("w", lambda v: v * 1.0001), 0.00003).alias("near"))


@register(_each_sql("list_transform(list_zip(w, coalesce(v, list_transform(w, lambda y: y + 0.5))), lambda p: p[2] - p[1])", f"(SELECT *, lead(w) OVER (PARTITION BY read_id ORDER BY blk) AS v FROM {_W})"))
def difference_blocks(spark, d):
    return _each(signal.difference_blocks(v_block(spark, d, 64), 0.5), F.col("w"))


# features times a fixed matrix of 64 x 4; the second one has other weights
_AFFINE = f"""WITH x AS (SELECT read_id, blk, unnest(w) AS value, unnest(range(64)) AS feature FROM {_W}),
    m AS (SELECT f.range AS feature, u.range AS unit, ((f.range * 3 + u.range * 5) % 7 - 3) / 4.0 AS weight FROM range(64) f, range(4) u)"""


_FEATURE, _UNIT = np.meshgrid(np.arange(64), np.arange(4), indexing="ij")
_M, _OTHER, _BIAS = ((_FEATURE * 3 + _UNIT * 5) % 7 - 3) / 4.0, ((_FEATURE + _UNIT) % 5 - 2) / 8.0, np.arange(4) / 8.0


def _units(layer: DataFrame) -> DataFrame:
    return layer.select("read_id", "blk", F.posexplode("w").alias("unit", "value")).select("read_id", "blk", "unit", r(F.col("value")).alias("value"))


@register(f"{_AFFINE} SELECT read_id, blk, unit::INT AS unit, {rs('sum(value * weight) + unit / 8.0')} AS value FROM x JOIN m USING (feature) GROUP BY read_id, blk, unit")
def affine(spark, d):
    return _units(network.affine_blocks(v_block(spark, d, 64), _M, _BIAS))


@register(
    f"""{_AFFINE}, y AS (SELECT x.read_id, x.blk, u.range AS unit, sum(value * value * ((feature + u.range) % 5 - 2) / 8.0) AS value FROM x, range(4) u GROUP BY ALL)
    SELECT read_id, blk, unit::INT AS unit, {rs('tanh(a.value + y.value + unit / 8.0)')} AS value
    FROM (SELECT read_id, blk, unit, sum(value * weight) AS value FROM x JOIN m USING (feature) GROUP BY ALL) a JOIN y USING (read_id, blk, unit)"""
)
def feedforward2_tanh(spark, d):
    x = v_block(spark, d, 64)
    # both layers in one product: the features, and their squares behind them
    both = x.withColumn("w", F.concat("w", F.transform("w", lambda v: v * v)))
    return _units(network.affine_blocks(both, np.concatenate([_M, _OTHER]), _BIAS, "tanh"))


@register(f"{_AFFINE} SELECT read_id, blk, unit::INT AS unit, {rs('tanh(sum(value * weight) + unit / 8.0)')} AS value FROM x JOIN m USING (feature) GROUP BY read_id, blk, unit")
def feedforward_tanh(spark, d):
    return _units(network.affine_blocks(v_block(spark, d, 64), _M, _BIAS, "tanh"))


_SOFT = f"""{_AFFINE}, z AS (SELECT read_id, blk, unit, (sum(value / 1.5 * 2 * weight) + unit / 8.0) / 2 AS value FROM x JOIN m USING (feature) GROUP BY read_id, blk, unit)
    SELECT read_id, blk, unit::INT AS unit, {rs('exp(value) / sum(exp(value)) OVER (PARTITION BY read_id, blk)')} AS value FROM z"""


@register(_SOFT)
def softmax_with_temperature(spark, d):
    return _units(network.softmax_blocks(v_block(spark, d, 64), _M, _BIAS, 1.5, 2.0))


@register(f"{_AFFINE} SELECT read_id, blk, unit::INT AS unit, {rs('exp(sum(value * weight) + unit / 8.0)')} AS value FROM x JOIN m USING (feature) GROUP BY read_id, blk, unit")
def feedforward_exp(spark, d):
    return _units(network.affine_blocks(v_block(spark, d, 64), _M, _BIAS, "exp"))


@register(f"SELECT p.read_id, p.pos, (row - 1)::INT AS row, {rs('x')} AS x FROM {PATH} p JOIN (SELECT read_id, unnest(w) AS x, generate_subscripts(w, 1) AS row FROM {_B} WHERE blk = 0) b ON p.state = b.read_id")
def embedding_gather(spark, d):
    """Each state's vector, the first of the read of its number, in the place of the state."""
    columns = v_block(spark, d, 64).where("blk = 0").select(F.col("read_id").alias("key"), "w")
    found = network.gather_columns(v_path(spark, d).select("read_id", "pos", F.col("state").alias("key")), columns)
    return found.select("read_id", "pos", F.posexplode("w").alias("row", "x")).select("read_id", "pos", "row", r(F.col("x")).alias("x"))


@register(f"SELECT read_id, {rs('max(x)')} AS largest, {rs('min(x)')} AS smallest, arg_max(blk * 64 + row - 1, (x, -blk, -row)) AS at_max, arg_min(blk * 64 + row - 1, (x, blk, row)) AS at_min FROM (SELECT read_id, blk, unnest(w) AS x, generate_subscripts(w, 1) AS row FROM {_W}) GROUP BY read_id")
def matrix_extrema(spark, d):
    found = sequence.matrix_extrema(v_block(spark, d, 64))
    return found.select("read_id", r(F.col("largest")).alias("largest"), r(F.col("smallest")).alias("smallest"), "at_max", "at_min")


@register(f"SELECT read_id, (row - 1)::INT AS row, arg_max(blk, (x, -blk)) AS blk, {rs('max(x)')} AS x FROM (SELECT read_id, blk, unnest(w) AS x, generate_subscripts(w, 1) AS row FROM {_W}) GROUP BY ALL")
def column_extrema(spark, d):
    return sequence.column_extrema(v_block(spark, d, 64)).select("read_id", "row", "blk", r(F.col("x")).alias("x"))


_ARRAYS = {
    "shifted": (lambda w: arrays.shift_scale(w, F.lit(0.1), F.lit(0.5)), "list_transform(w, lambda v: (v - 0.1) / 0.5)"),
    "clipped": (lambda w: arrays.clip(w, 0.2), "list_transform(w, lambda v: greatest(-0.2, least(0.2, v)))"),
    "filtered": (lambda w: arrays.replace_large(w, 0.3, 9.0), "list_transform(w, lambda v: CASE WHEN abs(v) > 0.3 THEN 9.0 ELSE v END)"),
    "differences": (lambda w: arrays.difference(w, 0.25), "list_transform(list_zip(w, list_append(w[2:], NULL)), lambda p: coalesce(p[2] - p[1], 0.25))"),
    "live": (lambda w: arrays.live_slice(w, F.lit(3), F.lit(60)), "w[4:60]"),
    "remainders": (lambda w: arrays.modulo(F.transform(w, lambda x: F.floor(F.abs(x) * 1000).cast("long")), 7), "list_transform(w, lambda v: floor(abs(v) * 1000)::BIGINT % 7)"),
    "logs": (lambda w: F.transform(w, lambda x: act.log(F.abs(x) + 0.01)), "list_transform(w, lambda v: ln(abs(v) + 0.01))"),
    "scores": (lambda w: F.transform(w, lambda x: quality.q_score(F.abs(x))), "list_transform(w, lambda v: -10 * log10(1 - least(abs(v), 0.99999)))"),
}


def _register_array(name: str, f, sql: str) -> None:
    _queries[f"array_{name}"] = lambda spark, d: _each(v_block(spark, d, 64), f(F.col("w")))
    _sql[f"array_{name}"] = _each_sql(sql, _W)


for _name, (_f, _s) in _ARRAYS.items():
    _register_array(_name, _f, _s)


@register(f"SELECT read_id, blk, array_to_string(list_transform(w, lambda v: chr(least(round(33 - 10 * log10(1 - least(abs(v), 0.99999))), 126)::INT)), '') AS phreds FROM {_W}")
def phred_strings(spark, d):
    return v_block(spark, d, 64).select("read_id", "blk", quality.phred_string(F.transform("w", F.abs)).alias("phreds"))


@register(f"SELECT read_id, blk, round(64 / 7)::INT AS factor FROM {_W}")
def down_sample_factors(spark, d):
    return v_block(spark, d, 64).select("read_id", "blk", arrays.down_sample_factor(F.col("w"), F.slice("w", 1, 7)).alias("factor"))


# ---------------------------------------------------------------- functions

_X = f"(SELECT read_id, idx, (value - 30) / 20.0 AS x, (value + 1) / 200.0 AS p FROM {SIGNAL})"


def _scaled(spark, d):
    return v_signal(spark, d).select("read_id", "idx", ((F.col("value") - 30) / 20.0).alias("x"), ((F.col("value") + 1) / 200.0).alias("p"))


@register(
    f"""SELECT read_id, idx, {rs('1 / (1 + exp(-x))')} AS logistic, {rs('x / (1 + exp(-x))')} AS swish, {rs('tanh(x)')} AS tanh_x, {rs('exp(x)')} AS exp_x,
    {rs('CASE WHEN x >= 0 THEN x ELSE exp(x) - 1 END')} AS elu, {rs('greatest(x, 0.0)')} AS relu, {rs('ln(1 + exp(-abs(x))) + greatest(x, 0.0)')} AS softplus,
    {rs('ln(0.01 + 0.99 * exp(x))')} AS robust_log, {rs('greatest(x, 0.5) + ln(1 + exp(-abs(x - 0.5)))')} AS log_sum_exp FROM {_X}"""
)
def activations(spark, d):
    x = F.col("x")
    shown = {"logistic": act.logistic(x), "swish": act.swish(x), "tanh_x": F.tanh(x), "exp_x": F.exp(x), "elu": act.elu(x), "relu": act.relu(x), "softplus": act.softplus(x), "robust_log": act.robust_log(F.exp(x), 0.01), "log_sum_exp": act.log_sum_exp(x, F.lit(0.5))}
    return _scaled(spark, d).select("read_id", "idx", *[r(v).alias(k) for k, v in shown.items()])


@register(
    f"""SELECT read_id, idx, {rs('-abs(x - 0.25) / 1.5 - ln(1.5) - ln(2)')} AS log_pdf, {rs('exp(-abs(x - 0.25) / 1.5) / 3')} AS pdf,
    {rs('sign(x - 0.25) / 1.5')} AS d_loc, {rs('(abs(x - 0.25) / 1.5 - 1) / 1.5')} AS d_scale, {rs('abs(x - 0.25) / 1.5 - 1')} AS d_log_scale,
    {rs('exp(-abs(x - 0.25) / 1.5) / 3 * sign(x - 0.25) / 1.5')} AS pdf_d_loc, {rs('exp(-abs(x - 0.25) / 1.5) / 3 * (abs(x - 0.25) / 1.5 - 1) / 1.5')} AS pdf_d_scale,
    {rs('exp(-abs(x - 0.25) / 1.5) / 3 * (abs(x - 0.25) / 1.5 - 1)')} AS pdf_d_log_scale FROM {_X}"""
)
def laplace(spark, d):
    a = (F.col("x"), F.lit(0.25), F.lit(1.5))
    shown = {"log_pdf": dist.log_laplace, "pdf": dist.laplace, "d_loc": dist.d_log_laplace_loc, "d_scale": dist.d_log_laplace_scale, "d_log_scale": dist.d_log_laplace_log_scale, "pdf_d_loc": dist.d_laplace_loc, "pdf_d_scale": dist.d_laplace_scale, "pdf_d_log_scale": dist.d_laplace_log_scale}
    return _scaled(spark, d).select("read_id", "idx", *[r(f(*a)).alias(k) for k, f in shown.items()])


@register(
    f"""SELECT read_id, idx, {rs('1 / (1 + exp(-x))')} AS cdf, {rs('-ln(1 + exp(-x))')} AS log_cdf, {rs('exp(-x) / pow(1 + exp(-x), 2)')} AS pdf,
    {rs('ln(p / (1 - p))')} AS quantile FROM {_X} WHERE p > 0 AND p < 1"""
)
def logistic_distribution(spark, d):
    x = F.col("x")
    rows = _scaled(spark, d).where("p > 0 and p < 1")
    return rows.select("read_id", "idx", r(dist.p_logistic(x)).alias("cdf"), r(dist.log_p_logistic(x)).alias("log_cdf"), r(dist.d_logistic(x)).alias("pdf"), r(dist.q_logistic(F.col("p"))).alias("quantile"))


_H = "pow(x / scale, shape)"
_H1 = "pow((x + 1) / scale, shape)"
_RX = f"(SELECT read_id, run_idx, shape, scale, 1.0 + run_idx % 5 AS x FROM {RUN} WHERE scale > 0.2)"


def _weibull_rows(spark, d):
    return v_run(spark, d).where("scale > 0.2").withColumn("x", 1.0 + F.col("run_idx") % 5)


@register(f"SELECT read_id, run_idx, {rs(f'1 - exp(-{_H})')} AS cdf, {rs(f'greatest(-700, ln(1 - exp(-{_H})))', 4)} AS log_cdf, {rs(f'greatest(-700, -{_H})', 4)} AS log_survival, {rs(f'shape * {_H} * exp(-{_H}) / x')} AS pdf FROM {_RX}")
def weibull(spark, d):
    a = (F.col("x"), F.col("shape"), F.col("scale"))
    low = lambda v: F.greatest(F.lit(-700.0), v)
    return _weibull_rows(spark, d).select("read_id", "run_idx", r(dist.p_weibull(*a)).alias("cdf"), r(low(dist.log_p_weibull(*a)), 4).alias("log_cdf"), r(low(dist.log_survival_weibull(*a)), 4).alias("log_survival"), r(dist.d_weibull(*a)).alias("pdf"))


@register(
    f"""SELECT read_id, run_idx, {rs(f'1 - exp(-{_H1})')} AS cdf, {rs(f'greatest(-700, ln(1 - exp(-{_H1})))', 4)} AS log_cdf, {rs(f'greatest(-700, -{_H1})', 4)} AS log_survival,
    {rs(f'exp(-{_H}) - exp(-{_H1})')} AS pmf, {rs(f'exp(-pow((x - 1) / scale, shape)) - exp(-{_H})')} AS pmf_before FROM {_RX}"""
)
def discrete_weibull(spark, d):
    a = (F.col("x"), F.col("shape"), F.col("scale"))
    low = lambda v: F.greatest(F.lit(-700.0), v)
    return _weibull_rows(spark, d).select(
        "read_id", "run_idx", r(dist.p_discrete_weibull(*a)).alias("cdf"), r(low(dist.log_p_discrete_weibull(*a)), 4).alias("log_cdf"), r(low(dist.log_survival_discrete_weibull(*a)), 4).alias("log_survival"),
        r(dist.d_discrete_weibull(*a)).alias("pmf"), r(dist.d_discrete_weibull(F.col("x") - 1, F.col("shape"), F.col("scale"))).alias("pmf_before"),
    )


@register(f"SELECT read_id, run_idx, {rs('lgamma(x + 3) - lgamma(4.0) - lgamma(x)')} AS log_choose, {rs('lgamma(x + 1.5) - lgamma(x + 1) - lgamma(1.5) + 1.5 * ln(0.7) + x * ln(0.3)')} AS log_neg_binomial, {rs('pow(x, 0.5) - 1')} AS power_minus_one, {rs('pow(1 + x, 1.5)')} AS one_plus_power FROM {_RX}")
def gamma_functions(spark, d):
    x = F.col("x")
    return _weibull_rows(spark, d).select(
        "read_id", "run_idx", r(dist.log_choose(x + 2, F.lit(3.0))).alias("log_choose"), r(dist.log_neg_binomial(x, F.lit(1.5), F.lit(0.3))).alias("log_neg_binomial"),
        r(dist.power_minus_one(x, F.lit(0.5))).alias("power_minus_one"), r(dist.one_plus_power(x, F.lit(1.5))).alias("one_plus_power"),
    )


@register(f"SELECT read_id, run_idx, {rs('list_sum(list_transform(range(1, 101), lambda i: exp(-pow(i / scale, shape))))')} AS mean FROM {RUN}")
def discrete_weibull_mean(spark, d):
    return v_run(spark, d).select("read_id", "run_idx", r(dist.discrete_weibull_mean(F.col("shape"), F.col("scale"))).alias("mean"))


@register(f"SELECT read_id, idx, {rs('-10 * log10(1 - least(p, 0.99999))')} AS q, chr(least(round(33 - 10 * log10(1 - least(p, 0.99999))), 126)::INT) AS c FROM {_X} WHERE p >= 0")
def phred_scores(spark, d):
    return _scaled(spark, d).where("p >= 0").select("read_id", "idx", r(quality.q_score(F.col("p"))).alias("q"), quality.phred(F.col("p")).alias("c"))


@register("SELECT event_id, n, round((sqrt(1 + 2 * n) - 1) / 2)::INT AS n_base, (n // 4)::INT AS n_base_runs FROM (SELECT event_id, 4 * (1 + event_id % 30) AS n FROM events)")
def bases_of_weights(spark, d):
    """How many bases a block of so many weights is for, widths taken from the events' numbers."""
    rows = table(spark, d, "events").select("event_id", (4 * (1 + F.col("event_id") % 30)).alias("n"))
    return rows.select("event_id", "n", quality.n_base_of_weights(F.col("n")).alias("n_base"), quality.n_base_of_runs(F.col("n")).alias("n_base_runs"))


# ---------------------------------------------------------------- paths and sequences

_MOVED = f"(SELECT *, lag(state) OVER (PARTITION BY read_id ORDER BY pos) AS before, max(pos) OVER (PARTITION BY read_id) AS last FROM {PATH})"
_LETTER = "substr('ACGTZ', state % 4 + 1, 1)"


@register(f"SELECT read_id, pos, state FROM {_MOVED} WHERE state <> before")
def change_positions(spark, d):
    return sequence.change_positions(v_path(spark, d)).select("read_id", "pos", "state")


@register(f"SELECT read_id, coalesce(sum((state <> before)::INT), 0)::BIGINT AS changes FROM {_MOVED} GROUP BY read_id")
def change_counts(spark, d):
    return sequence.change_counts(v_path(spark, d))


@register(f"SELECT read_id, string_agg({_LETTER}, '' ORDER BY pos) AS sequence FROM {_MOVED} WHERE before IS NULL OR state <> before GROUP BY read_id")
def collapse_repeats(spark, d):
    return sequence.collapse_repeats(v_path(spark, d), 4)


_EMIT = f"""SELECT read_id, string_agg({_LETTER}, '' ORDER BY pos) AS basecall,
    string_agg(chr(least(round(33 - 10 * log10(1 - least(exp(q), 0.99999))), 126)::INT), '' ORDER BY pos) AS quality FROM {_MOVED} WHERE state <> before AND pos < last GROUP BY read_id"""


@register(_EMIT)
def emit_bases_phred(spark, d):
    return sequence.emit_bases(v_path(spark, d), 4)


@register(f"SELECT read_id, reverse(basecall) AS basecall, reverse(quality) AS quality FROM ({_EMIT})")
def emit_bases_reversed(spark, d):
    return sequence.emit_bases(v_path(spark, d), 4, reverse=True)


_RUNS = f"""(SELECT read_id, (run - 1)::INT AS run_idx, substr('ACGTZ', arg_min(state, pos) % 4 + 1, 1) AS base, arg_min(shape, pos) AS shape, arg_min(scale, pos) AS scale, count(*)::INT AS dwell
    FROM (SELECT *, sum((state < 4)::INT) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM {PATH}) WHERE run > 0 GROUP BY read_id, run)"""


@register(f"SELECT read_id, run_idx, base, {rs('shape')} AS shape, {rs('scale')} AS scale, dwell FROM {_RUNS}")
def run_emission(spark, d):
    return sequence.emit_runs(v_path(spark, d), 4).select("read_id", "run_idx", "base", r(F.col("shape")).alias("shape"), r(F.col("scale")).alias("scale"), "dwell")


@register(f"SELECT read_id, string_agg(repeat(base, greatest(1, floor(scale * CASE WHEN base IN ('A', 'T') THEN 1.02 ELSE 1.04 END)::INT)), '' ORDER BY run_idx) AS sequence FROM {RUN} GROUP BY read_id")
def run_decode(spark, d):
    return basecall.decode_runs(v_run(spark, d))


@register(f"SELECT read_id, string_agg(base, '' ORDER BY run_idx) AS sequence FROM {RUN} GROUP BY read_id")
def run_decode_rlc(spark, d):
    return basecall.decode_runs(v_run(spark, d), expand=False)


@register(f"SELECT read_id, sum(1 + round(list_sum(list_transform(range(1, 101), lambda i: exp(-pow(i / scale, shape))))))::BIGINT AS total_length FROM {RUN} GROUP BY read_id")
def run_mean_length(spark, d):
    return sequence.run_mean_lengths(v_run(spark, d))


@register(f"SELECT read_id, sum((state - 4 >= 0)::BIGINT)::BIGINT AS total_length FROM {PATH} GROUP BY read_id")
def run_unit_length(spark, d):
    return sequence.move_counts(v_path(spark, d).withColumn("state", F.col("state") - 4))


@register(
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM c),
    u AS (SELECT doc_id, c, count(*) AS n, min(i) AS i FROM g GROUP BY doc_id, c, g)
    SELECT doc_id, string_agg(c, '' ORDER BY i) AS letters, string_agg(n::VARCHAR, ',' ORDER BY i) AS lengths FROM u GROUP BY doc_id"""
)
def rle_compress(spark, d):
    return sequence.compress_texts(views.v_seq(spark, d).where(F.length("text") > 0), "doc_id", "text")


@register("SELECT doc_id, reverse(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS reversed FROM documents")
def reverse_sequence(spark, d):
    return views.v_seq(spark, d).select("doc_id", F.reverse(F.regexp_replace("text", "[^A-Za-z]", "")).alias("reversed"))


# ---------------------------------------------------------------- chains

_NB = 4
_CHAINS = {"flip_flop": chain.flip_flop(_NB), "run_length": chain.run_length(_NB), "run_length_v1": chain.run_length_v1(_NB), "flip_flop_states": chain.flip_flop_states(_NB)}


def _log_sum_sql(terms: list[str]) -> str:
    if len(terms) == 1:
        return terms[0]
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({x} - {top})' for x in terms)}))"


def _fold_sql(t: chain.Topology, log_sum: bool, source: str | None = None) -> str:
    """Common tables f (states after each block) and z (last block) by recursion over blocks of ``source``."""
    def step(choices) -> str:
        terms = [f"f.s[{a + 1}] + b.w[{b + 1}]" for a, b in choices]
        return _log_sum_sql(terms) if log_sum else f"greatest({', '.join(terms)})"

    return f"""b AS MATERIALIZED {source or block_sql(t.n_weight, 2.0)},
    f AS (SELECT DISTINCT read_id, 0::BIGINT AS k, [{', '.join(['0.0::DOUBLE'] * t.n_state)}] AS s FROM b
        UNION ALL SELECT f.read_id, f.k + 1, [{', '.join(map(step, t.steps))}] FROM f JOIN b ON b.read_id = f.read_id AND b.blk = f.k),
    z AS (SELECT read_id, arg_max(s, k) AS s, max(k) AS n FROM f GROUP BY read_id)"""


def _path_sql(t: chain.Topology, source: str | None = None) -> str:
    """The best path, traced back from the last state."""
    src, row, real = t.tables()
    pad = lambda a: "[" + ", ".join("[" + ", ".join(str(int(v)) for v in line) + "]" for line in a) + "]"
    options = ", ".join("[" + ", ".join(f"f.s[{a + 1}] + b.w[{b + 1}]" for a, b in choices) + "]" for choices in t.steps)
    return f"""WITH RECURSIVE {_fold_sql(t, False, source)},
    p AS (SELECT read_id, n AS pos, (list_position(s, list_max(s)) - 1)::BIGINT AS state, NULL::DOUBLE AS next_q, list_max(s) AS score FROM z
        UNION ALL SELECT q.read_id, q.pos - 1, q.src[q.c], q.w[q.row[q.c] + 1], q.score FROM (
            SELECT p.read_id, p.pos, p.score, b.w, {pad(src)}[p.state + 1] AS src, {pad(row)}[p.state + 1] AS row,
                list_position([{options}][p.state + 1], list_max([{options}][p.state + 1])) AS c
            FROM p JOIN f ON f.read_id = p.read_id AND f.k = p.pos - 1 JOIN b ON b.read_id = p.read_id AND b.blk = p.pos - 1) q)
    SELECT a.read_id, a.pos, a.state, {rs('b.next_q', 5)} AS q, {rs('a.score', 4)} AS score FROM p a LEFT JOIN p b ON b.read_id = a.read_id AND b.pos = a.pos - 1"""


def _both_sql(t: chain.Topology, source: str | None = None) -> str:
    """Common tables f and g: log sums over all paths up to each block's beginning and from there on."""
    out = {}
    for to, choices in enumerate(t.steps):
        for a, b in choices:
            out.setdefault(a, []).append(f"b.w[{b + 1}] + g.s[{to + 1}]")
    return f"""{_fold_sql(t, True, source)},
    g AS (SELECT read_id, n AS k, [{', '.join(['0.0::DOUBLE'] * t.n_state)}] AS s FROM z
        UNION ALL SELECT g.read_id, g.k - 1, [{', '.join(_log_sum_sql(out[k]) for k in range(t.n_state))}] FROM g JOIN b ON b.read_id = g.read_id AND b.blk = g.k - 1)"""


def _posterior_sql(t: chain.Topology, source: str | None = None) -> str:
    """Common table p: every block's weights with those of steps replaced by log posteriors."""
    steps = {}
    for to, choices in enumerate(t.steps):
        for a, b in choices:
            steps.setdefault(b, []).append(f"f.s[{a + 1}] + b.w[{b + 1}] + g.s[{to + 1}]")
    used = [_log_sum_sql(steps[k]) if k in steps else "NULL" for k in range(t.n_weight)]
    return f"""{_both_sql(t, source)},
    u AS (SELECT b.read_id, b.blk, b.w, [{', '.join(used)}] AS x FROM b JOIN f ON f.read_id = b.read_id AND f.k = b.blk JOIN g ON g.read_id = b.read_id AND g.k = b.blk + 1),
    h AS (SELECT *, list_max(x) + ln(list_sum(list_transform(list_filter(x, lambda v: v IS NOT NULL), lambda v: exp(v - list_max(x))))) AS total FROM u),
    p AS (SELECT read_id, blk, list_transform(list_zip(w, x), lambda v: coalesce(v[2] - total, v[1])) AS w FROM h)"""


def _trace_sql(t: chain.Topology) -> str:
    """Shares of states that the first block's steps come from, then of those that each block's go to."""
    share = lambda terms: f"least(floor(255 * ({' + '.join(f'exp(least(w[{k + 1}], 0.0))' for k in terms)}) + 0.5), 255)"
    came = [share([b for choices in t.steps for a, b in choices if a == k]) for k in range(t.n_state)]
    gone = [share([b for _, b in choices]) for choices in t.steps]
    return f"""WITH RECURSIVE {_posterior_sql(t)}, s AS (SELECT read_id, 0 AS pos, [{', '.join(came)}] AS x FROM p WHERE blk = 0 UNION ALL SELECT read_id, blk + 1, [{', '.join(gone)}] FROM p)
    SELECT read_id, pos::BIGINT AS pos, (state - 1)::INT AS state, x::BIGINT AS share FROM (SELECT read_id, pos, unnest(x) AS x, generate_subscripts(x, 1) AS state FROM s)"""


def _register_chain(name: str, t: chain.Topology) -> None:
    blocks = lambda spark, d: v_block(spark, d, t.n_weight, 2.0)

    def score(spark, d):
        return chain.viterbi_scores(blocks(spark, d), t).select("read_id", r(F.col("score"), 4).alias("score"))

    def partition(spark, d):
        return chain.log_partitions(blocks(spark, d), t).select("read_id", r(F.col("log_z"), 4).alias("log_z"))

    def path(spark, d):
        return chain.decode(blocks(spark, d), t).select("read_id", "pos", "state", r(F.col("q"), 5).alias("q"), r(F.col("score"), 4).alias("score"))

    def posterior(spark, d):
        return _each(chain.posteriors(blocks(spark, d), t), F.col("w"), 4)

    def state(spark, d):
        return _each(chain.states(blocks(spark, d), t, False).withColumnRenamed("pos", "blk"), F.col("p"), 4)

    _queries.update({f"{name}_{f.__name__}": f for f in (score, partition, path, posterior, state)})
    z = " + ".join(f"exp(s[{k + 1}] - list_max(s))" for k in range(t.n_state))
    _sql[f"{name}_score"] = f"WITH RECURSIVE {_fold_sql(t, False)} SELECT read_id, {rs('list_max(s)', 4)} AS score FROM z"
    _sql[f"{name}_partition"] = f"WITH RECURSIVE {_fold_sql(t, True)} SELECT read_id, {rs(f'list_max(s) + ln({z})', 4)} AS log_z FROM z"
    _sql[f"{name}_path"] = _path_sql(t)
    _sql[f"{name}_posterior"] = f"WITH RECURSIVE {_posterior_sql(t)} {_each_sql('w', 'p', 4)}"
    joint = "list_transform(list_zip(f.s, g.s), lambda v: v[1] + v[2])"
    _sql[f"{name}_state"] = f"""WITH RECURSIVE {_both_sql(t)}, j AS (SELECT f.read_id, f.k AS blk, {joint} AS s FROM f JOIN g ON g.read_id = f.read_id AND g.k = f.k)
        {_each_sql('list_transform(s, lambda v: exp(v - list_max(s)) / list_sum(list_transform(s, lambda u: exp(u - list_max(s)))))', 'j', 4)}"""


for _name, _t in _CHAINS.items():
    _register_chain(_name, _t)


@register(_trace_sql(_CHAINS["flip_flop"]))
def flip_flop_trace(spark, d):
    t = _CHAINS["flip_flop"]
    found = chain.traces(v_block(spark, d, t.n_weight, 2.0), t)
    return found.select("read_id", "pos", F.posexplode("trace").alias("state", "share"))


@register(
    f"""SELECT read_id, pos - 1 AS pos, CASE WHEN state = before THEN -1 ELSE state END AS state, score FROM (
    SELECT *, lag(state) OVER (PARTITION BY read_id ORDER BY pos) AS before FROM ({_path_sql(_CHAINS["run_length_v1"])})) WHERE pos > 0"""
)
def run_length_v1_moves(spark, d):
    t = _CHAINS["run_length_v1"]
    return chain.moves_v1(chain.decode(v_block(spark, d, t.n_weight, 2.0), t)).select("read_id", "pos", "state", r(F.col("score"), 4).alias("score"))


@register(f"SELECT read_id, pos, CASE WHEN state < 4 THEN state ELSE -1 END AS state FROM ({_path_sql(_CHAINS['flip_flop'])})")
def flip_flop_combined_stays(spark, d):
    t = _CHAINS["flip_flop"]
    return chain.combine_stays(chain.decode(v_block(spark, d, t.n_weight, 2.0), t), _NB).select("read_id", "pos", "state")


# ---------------------------------------------------------------- records

_CALLS = f"""(SELECT e.read_id, 'events' AS filename, basecall, quality, length(basecall) AS sequence_length, n AS nblock, n AS nsample, -n / 4.0 AS score FROM ({_EMIT}) e
    JOIN (SELECT read_id, count(*) AS n FROM {PATH} GROUP BY read_id) USING (read_id))"""
_HEAD = """printf('%s  { "filename" : "%s", "uuid" : "%s", "normalised_score" : %.6f,  "nblock" : %d,  "sequence_length" : %d,  "blocks_per_base" : %.6f, "nsample" : %d, "trim" : [ %d, %d ] }',
    read_id, filename, read_id, -score / nblock, nblock, sequence_length, nblock / sequence_length, nsample, 0, nsample)"""


_NAMES = ("fasta", "FASTA", "fastq", "sam", "bam")


@register(f"SELECT event_id, ['{"', '".join(_NAMES)}'][event_id % {len(_NAMES)} + 1] AS name, event_id % {len(_NAMES)} IN (0, 2, 3) AS known FROM events")
def output_formats(spark, d):
    """Which names of formats are known, a name for each event."""
    names = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES)).cast("int") + 1)
    return table(spark, d, "events").select("event_id", names.alias("name")).withColumn("known", F.col("name").isin(*text_format.OUTPUT_FORMATS))


def _calls(spark, d):
    path = v_path(spark, d)
    sizes = path.groupBy("read_id").agg(F.count("*").alias("n"))
    rows = sequence.emit_bases(path, 4).join(sizes, "read_id")
    n = F.col("n")
    return rows.select("read_id", F.lit("events").alias("filename"), "basecall", "quality", F.length("basecall").alias("sequence_length"), n.alias("nblock"), n.alias("nsample"), (-n / 4.0).alias("score"), F.lit(0).alias("trim_start"), n.alias("trim_end"))


@register(f"SELECT read_id, '>' || {_HEAD} || chr(10) || basecall AS record FROM {_CALLS}")
def fasta_records(spark, d):
    return text_format.format_calls(_calls(spark, d), "fasta")


@register(f"SELECT read_id, '@' || {_HEAD} || chr(10) || basecall || chr(10) || '+' || chr(10) || quality AS record FROM {_CALLS}")
def fastq_records(spark, d):
    return text_format.format_calls(_calls(spark, d), "fastq")


@register(f"SELECT read_id, concat_ws(chr(9), read_id, '4', '*', '0', '0', '*', '*', '0', '0', basecall, quality) AS record FROM {_CALLS}")
def sam_records(spark, d):
    return text_format.format_calls(_calls(spark, d), "sam")


@register(f"SELECT read_id, '# ' || read_id || chr(10) || string_agg(printf('%s%s%.6f%s%.6f%s%d', base, chr(9), shape, chr(9), scale, chr(9), 1), chr(10) ORDER BY run_idx) AS record FROM {RUN} GROUP BY read_id")
def run_records(spark, d):
    return text_format.run_records(v_run(spark, d))


@register(f"SELECT read_id, (run_idx)::INT AS run_idx, base, {rs('shape')} AS shape, {rs('scale')} AS scale, 1::INT AS dwell FROM {RUN}")
def run_file(spark, d):
    """Run records written as text and read back."""
    place = session.scratch_path(spark, "run-file")
    text_format.write_records(text_format.run_records(v_run(spark, d)), place)
    return text_format.read_runs(spark, place).select("read_id", "run_idx", "base", r(F.col("shape")).alias("shape"), r(F.col("scale")).alias("scale"), "dwell")


@register(f"SELECT read_id, run_idx::INT AS run_idx, base, {rs('shape')} AS shape, {rs('scale')} AS scale, 1::INT AS dwell FROM {RUN} WHERE read_id IN (SELECT read_id FROM {RUN} GROUP BY read_id ORDER BY read_id LIMIT 3)")
def run_file_limit(spark, d):
    """The first three records only: the limit is on records, not on lines."""
    return basecall.limit_reads(v_run(spark, d), 3).select("read_id", F.col("run_idx").cast("int").alias("run_idx"), "base", r(F.col("shape")).alias("shape"), r(F.col("scale")).alias("scale"), "dwell")


@register(f"SELECT 64 AS nr, count(*)::INT AS nc, {rs('sum(list_sum(w))')} AS total FROM {_W} GROUP BY read_id")
def matrix_file(spark, d):
    """Matrices written in hex floats, a file each, and read back."""
    columns = F.transform(F.array_sort(F.collect_list(F.struct("blk", "w"))), lambda p: p["w"])
    found = v_block(spark, d, 64).groupBy("read_id").agg(columns.alias("data"))
    matrices = found.select(F.concat(F.lit("m"), F.col("read_id").cast("string")).alias("name"), F.lit(64).alias("nr"), F.size("data").alias("nc"), "data")
    place = session.scratch_path(spark, "matrix-file")
    text_format.matrix_records(matrices).write.partitionBy("name").text(place)
    read = text_format.read_matrices(spark, f"{place}/*/*")
    return read.select("nr", "nc", r(arrays.total(F.transform("data", arrays.total))).alias("total"))


@register(f"SELECT read_id, '>' || read_id || chr(10) || rtrim(regexp_replace(string_agg(base, '' ORDER BY run_idx), '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS record FROM {RUN} GROUP BY read_id")
def wrapped_fasta(spark, d):
    return text_format.wrapped_fasta(basecall.decode_runs(v_run(spark, d), expand=False))


# ---------------------------------------------------------------- networks and whole queries


def _register_network(name: str) -> None:
    def run(spark, d):
        n_base = 5 if name == "flip_flop" else 4
        reads = signal.to_reads(signal.normalise(v_signal(spark, d)))
        found = network.transitions(reads, name, network.synthetic_weights(name, n_base), n_base)
        return found.select("read_id", "blk", F.transform("w", lambda x: F.round(x, 4)).alias("w"))

    _queries[f"network_{name}"] = run


for _name in network.NETWORKS:
    _register_network(_name)


_LIVE = {"trim": (2, 1), "segmentation": (8, 0.0)}


@register()
def basecall_reads(spark, d):
    calls = basecall.basecall(v_signal(spark, d), network.synthetic_weights("flip_flop5", 4), **_LIVE)
    return calls.withColumn("score", F.round("score", 3))


@register()
def basecall_fastq(spark, d):
    return text_format.format_calls(basecall.basecall(v_signal(spark, d), network.synthetic_weights("flip_flop5", 4), limit=100, **_LIVE), "fastq")


@register()
def basecall_traces(spark, d):
    calls = basecall.basecall(v_signal(spark, d), network.synthetic_weights("flip_flop5", 4), trace=True, **_LIVE)
    return tables.trace_points(calls)


@register()
def basecall_run_reads(spark, d):
    runs = basecall.basecall_runs(v_signal(spark, d), network.synthetic_weights("run_length5", 4), **_LIVE)
    return runs.select("read_id", "run_idx", "base", F.round("shape", 4).alias("shape"), F.round("scale", 4).alias("scale"), "dwell")


@register(f"SELECT read_id, count(*)::INT AS n, {rs('sum(value)', 4)} AS total, {rs('arg_max(value, idx)')} AS last_value, true AS complete FROM {SIGNAL} GROUP BY read_id")
def streamed_reads(spark, d):
    """Chunks of 16 samples, dealt out to files by hash, come as a stream and are put together into reads again."""
    rows = v_signal(spark, d).withColumn("seq", F.floor(F.col("idx") / 16).cast("int"))
    samples = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda p: p["value"])
    chunks = rows.groupBy("read_id", "seq").agg(samples.alias("values")).withColumn("last", F.col("seq") == F.max("seq").over(Window.partitionBy("read_id")))
    source, place = session.scratch_path(spark, "chunks"), session.scratch_path(spark, "streamed")
    third = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # as many files as partitions, in three batches
    chunks.select("read_id", "seq", "last", "values").repartition(3 * third, F.xxhash64("read_id", "seq")).write.parquet(source)
    stream = spark.readStream.schema("read_id string, seq int, last boolean, values array<double>").option("maxFilesPerTrigger", third).parquet(source)
    query = assemble_reads(stream).writeStream.format("parquet").option("path", place).option("checkpointLocation", f"{place}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("read_id string, signal array<double>, complete boolean").parquet(place)
    return found.select("read_id", F.size("signal").alias("n"), r(arrays.total(F.col("signal")), 4).alias("total"), r(F.element_at("signal", -1)).alias("last_value"), "complete")


# ---------------------------------------------------------------- result tables under relational operators


@register(f"SELECT read_id, CASE WHEN state < 4 THEN 'flip' ELSE 'flop' END AS kind, count(*) AS n, sum(round(shape * 10000)::BIGINT)::BIGINT AS shape_units FROM {PATH} GROUP BY ROLLUP (read_id, kind)")
def state_rollup(spark, d):
    kind = F.when(F.col("state") < 4, "flip").otherwise("flop")
    return v_path(spark, d).withColumn("kind", kind).rollup("read_id", "kind").agg(F.count("*").alias("n"), F.sum(F.round(F.col("shape") * 10000).cast("long")).alias("shape_units"))


@register(f"SELECT base, dwell, count(*) AS n FROM {_RUNS} GROUP BY CUBE (base, dwell)")
def run_cube(spark, d):
    return sequence.emit_runs(v_path(spark, d), 4).cube("base", "dwell").agg(F.count("*").alias("n"))


@register(f"SELECT read_id, run_idx, base, dwell FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY dwell DESC, run_idx) AS k FROM {_RUNS}) WHERE k <= 3")
def longest_runs(spark, d):
    w = Window.partitionBy("read_id").orderBy(F.desc("dwell"), "run_idx")
    return sequence.emit_runs(v_path(spark, d), 4).withColumn("k", F.row_number().over(w)).where("k <= 3").select("read_id", "run_idx", "base", "dwell")


@register(f"WITH c AS (SELECT read_id, pos FROM {_MOVED} WHERE state <> before), t AS (SELECT read_id, idx AS pos FROM {SIGNAL} WHERE value > 60) (SELECT * FROM c INTERSECT SELECT * FROM t) UNION ALL (SELECT * FROM (SELECT * FROM t EXCEPT SELECT * FROM c))")
def change_sets(spark, d):
    c = sequence.change_positions(v_path(spark, d)).select("read_id", "pos")
    t = v_signal(spark, d).where("value > 60").select("read_id", F.col("idx").alias("pos"))
    return c.intersect(t).unionByName(t.subtract(c))


@register(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"""
)
def priced_lines(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
