"""Joins by place: intervals that overlap, and the latest earlier row of another stream.

Both cut the axis into bins, so that only equal keys are joined and a key with many rows is many tasks' work.

An overlap join gives each interval a level, the power of two that its length needs, so that it touches two bins
of its level at most. Pairs meet at the level of the longer one: the shorter is looked up there too. Which levels
occur, at most 63, is one row a side for the driver. A pair is kept in the bin of the later start only, hence once.

An as-of join unions both sides, carries the last row along within a bin, and takes what a bin begins with from the
last row of the bins before it, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.operators.sequence import by_position

#: Levels below this one are this one: very short intervals share bins.
LEAST_LEVEL = 4
ASOF_BIN = 4096


def _level(length: Column) -> Column:
    """The smallest power of two, as an exponent, that is no less than ``length``."""
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int"))


def _binned(df: DataFrame, start: str, end: str, levels: Column, name: str) -> DataFrame:
    rows = df.withColumn(name, F.explode(levels))
    first, last = (F.expr(f"shiftright(cast({x} as bigint), {name})") for x in (start, f"({end} - 1)"))
    return rows.withColumn(f"{name}_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal ``by`` whose whole-numbered intervals [start, end) share a place; all columns, ``by`` once.

    Names other than ``by`` must differ. Empty intervals and null ends match nothing; nor do null keys.
    """
    (a, b), (c, d) = left_span, right_span
    left, right = left.where(F.col(a) < F.col(b)), right.where(F.col(c) < F.col(d))
    x = left.withColumn("_own_l", _level(F.col(b) - F.col(a)))
    y = right.withColumn("_own_r", _level(F.col(d) - F.col(c)))
    found = [sorted(r[0] for r in z.select(k).distinct().collect()) for z, k in ((x, "_own_l"), (y, "_own_r"))]  # 63 levels at most
    # each at its own level, and at every level of longer ones on the other side
    levels = [F.array_distinct(F.concat(F.array(own), F.filter(F.array(*[F.lit(k) for k in other]).cast("array<int>"), lambda k, own=own: k > own))) for own, other in ((F.col("_own_l"), found[1]), (F.col("_own_r"), found[0]))]
    x = _binned(x, a, b, levels[0], "_at")
    y = _binned(y, c, d, levels[1], "_to")
    keys = [x[k] == y[k] for k in by] + [F.col("_at") == F.col("_to"), F.col("_at_bin") == F.col("_to_bin")]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    longer = F.greatest("_own_l", "_own_r") == F.col("_at")
    meet = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    once = F.expr(f"shiftright(cast(greatest({a}, {c}) as bigint), _at)") == F.col("_at_bin")
    return x.join(y, on & longer & meet & once).select(*[x[k] for k in by], *[x[k] for k in left.columns if k not in by], *[y[k] for k in right.columns if k not in by])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: float | None = None, bin_width: float = ASOF_BIN) -> DataFrame:
    """Each row of ``left`` with the columns of the latest row of ``right`` with equal ``by`` and an ``at`` no later.

    ``right``'s ``at`` is added as ``matched_at``; its columns are null where there is no such row, or none within
    ``tolerance``. Of rows of ``right`` with the same place the one with the largest columns, in their order, counts.
    Rows of ``left`` are all kept, those with a null place or key without a match; rows of ``right`` without a place
    match nothing. ``at`` is a number or a timestamp, ``tolerance`` and ``bin_width`` then seconds.
    """
    payload = [c for c in right.columns if c not in (*by, at)]
    fields = F.struct(F.col(at).alias("matched_at"), *payload)
    r = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(F.struct(*payload) if payload else F.lit(True)).alias("_p"))
    r = r.select(*by, at, *[F.col("_p")[c].alias(c) for c in payload]).select(*by, F.col(at).alias("_at"), fields.alias("_m"))
    row = F.struct(*left.columns)
    kind = r.schema["_m"].dataType
    both = left.select(*by, F.col(at).alias("_at"), F.lit(None).cast(kind).alias("_m"), row.alias("_l")).unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_bin", F.floor(F.col("_at").cast("double") / bin_width))
    inside = Window.partitionBy(*by, "_bin").orderBy("_at", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_own", F.last("_m", ignorenulls=True).over(inside))
    lasts = r.withColumn("_bin", F.floor(F.col("_at").cast("double") / bin_width)).groupBy(*by, "_bin").agg(F.max_by("_m", "_at").alias("_last"))
    bins = both.select(*by, "_bin").distinct().join(lasts, [*by, "_bin"], "left")
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_before is not null and _bin is not null").select(*by, "_bin", "_before")
    found = seen.where("_l is not null").join(carried, [*by, "_bin"], "left")
    match = F.coalesce("_own", "_before")
    usable = F.col("_at").isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    if tolerance is not None:
        usable = usable & (F.col("_at").cast("double") - match["matched_at"].cast("double") <= tolerance)
    found = found.withColumn("_m", F.when(usable, match))
    return found.select("_l.*", "_m.*")


def run_spans(runs: DataFrame, stride: int, offset: Column | int = 0) -> DataFrame:
    """``runs`` (read_id, run_idx, dwell, ...) with the samples [start, end) of each: its blocks, ``stride`` samples each, from ``offset`` on."""
    ordered = Window.partitionBy("read_id").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("dwell").over(ordered)
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    return runs.withColumn("end", shift + last * stride).withColumn("start", F.col("end") - F.col("dwell") * stride)


def base_spans(path: DataFrame, stride: int, offset: Column | int = 0) -> DataFrame:
    """(read_id, pos, state, start, end): the samples of each stretch of one state in ``path``, whose ``pos`` counts blocks."""
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    first = path.withColumn("before", F.lag("state").over(by_position())).withColumn("size", F.max("pos").over(Window.partitionBy("read_id")) + 1)
    first = first.where("before is null or state <> before")
    until = F.coalesce(F.lead("pos").over(by_position()), F.col("size"))
    return first.select("read_id", "pos", "state", (shift + F.col("pos") * stride).alias("start"), (shift + until * stride).alias("end"))
