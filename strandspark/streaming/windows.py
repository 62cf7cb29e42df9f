"""Event-time windows over streams of events (ts, key, value, ...): sessions and tumbling statistics.

Both emit a window once, when the watermark has passed its end; rows that come after that are dropped, as Spark
drops them. State holds a few numbers a session, and a tumbling window's values until it closes, since a median
absolute deviation needs them all: windows are to be short beside memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.operators.signal import MAD_SCALE


def sessions(events: DataFrame, by: str, gap: str, delay: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(by, start, end, n, total, largest): rows of a key that are less than ``gap`` apart."""
    grouped = events.withWatermark(ts, delay).groupBy(by, F.session_window(ts, gap).alias("session"))
    found = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return found.select(by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "total", "largest")


def median(values: Column) -> Column:
    """Of an array: the middle value, or the mean of the two in the middle."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda k: F.element_at(ordered, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def tumbling_mad(events: DataFrame, by: str, width: str, delay: str, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """(by, start, end, n, median, mad) of each window of ``width``, one every ``slide``; NaN and null values don't count."""
    finite = events.where(F.col(value).isNotNull() & ~F.isnan(value))
    window = F.window(ts, width, slide).alias("window") if slide else F.window(ts, width).alias("window")
    held = finite.withWatermark(ts, delay).groupBy(by, window).agg(F.collect_list(value).alias("values"))
    middle = held.withColumn("median", median(F.col("values")))
    # the median enters the function as an element of an array: worked out once, not once a value
    off = F.transform(F.array("median"), lambda m: median(F.transform("values", lambda x: F.abs(x - m))))[0]
    return middle.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.size("values").cast("long").alias("n"), "median", (MAD_SCALE * off).alias("mad"))
