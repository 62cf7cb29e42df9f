"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is what its rows must be repeated by, on average, to hold its share of the
target. Each document draws its count by inverting the Poisson distribution of that mean at a uniform
number hashed from its id, its text and the seed, is exploded by the count, and all copies are dealt out and
sorted by a hash, so their order is a global shuffle. A rate beyond SPLIT is the sum of equal smaller
ones, each with its own hash. Everything is DataFrame functions: text is shuffled once and never
leaves the JVM, and no source, however large, has to meet in one task.

Defined results: a null source is a source of its own; rows that repeat an id draw a count each, equal
rows the same one; null ids and texts hash as empty strings; copies of rows without an id are dealt out by
the row's place in the input, so that many of them don't meet; very long texts are hashed whole; a source without a weight, or with weight 0, is left out; an
empty table gives an empty table. The copy's number (from 1) is added as ``copy``, with underscores
where that name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import free_name
from strandspark.session import materialise

#: Largest rate of one draw, terms of its distribution (what lies beyond is 0 in doubles), sources that may be broadcast.
SPLIT, TERMS, BROADCAST_SOURCES, SALT = 32.0, 200, 10_000, 64


def uniform(key: Column) -> Column:
    """[0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def cumulative(rate: Column) -> Column:
    """The Poisson distribution's cumulative probabilities for 0, 1, ... TERMS."""
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("s"), F.array(zero).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["s"] + p).alias("s"), F.concat(acc["all"], F.array(acc["s"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add)["all"]


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: float | None) -> tuple[DataFrame, int]:
    """(source, draws, cdf) for each source that is repeated at all, and how many sources there are."""
    counts = materialise(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "source-counts")
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    weighted = counts.withColumn("weight", weight)
    rows, mass, n = weighted.agg(F.sum("n"), F.sum("weight"), F.count("*")).first()
    if not rows or not mass:
        return counts.limit(0).select("source", F.lit(1).alias("draws"), cumulative(F.lit(1.0)).alias("cdf")), 0
    rate = F.lit(float(total if total is not None else rows)) * F.col("weight") / F.lit(float(mass)) / F.col("n")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT).cast("int"))
    found = weighted.withColumn("rate", rate).where("rate > 0").withColumn("draws", draws)
    return materialise(found.select("source", "draws", cumulative(F.col("rate") / F.col("draws")).alias("cdf")), "source-rates"), n


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` repeated so that each source has its share (equal shares by default) of ``total`` rows (as many as there are)."""
    table, n = rates(docs, source_col, weights, total)
    source, draws, cdf, salt, copy, digest, place = (free_name(docs, x) for x in ("mix_source", "mix_draws", "mix_cdf", "mix_salt", "copy", "mix_digest", "mix_place"))
    table = table.toDF(source, draws, cdf)
    columns = docs.columns
    docs = docs.withColumn(digest, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn(place, F.monotonically_increasing_id())
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col(digest), F.lit(f":{seed}:"))
    same = F.col(source_col).eqNullSafe(F.col(source))
    if n <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), same)
    else:  # too many sources to broadcast: a source's rows are spread over SALT keys
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = docs.withColumn(salt + "_own", F.pmod(F.col(place), F.lit(SALT)).cast("int")).join(spread, same & (F.col(salt + "_own") == F.col(salt)))

    def draw(i: Column) -> Column:
        # the number is an element of an array before the filter's function sees it: hashed once, not once a term
        number = F.array(uniform(F.concat(key, i.cast("string"))))
        return F.transform(number, lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u)))[0]

    times = F.when(F.col(draws) == 1, draw(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda a, i: a + draw(i)))
    one = free_name(docs, "mix_one")
    exploded = joined.select(*columns, digest, place, F.posexplode(F.array_repeat(F.lit(True), times)).alias(copy, one))
    alone = F.when(F.col(id_col).isNull(), F.col(place))
    order = free_name(exploded, "mix_order")
    copies = exploded.select(*columns, (F.col(copy) + 1).alias(copy), F.xxhash64(F.lit(seed), F.col(id_col), F.col(digest), F.col(copy) + 1, alone).alias(order))
    return copies.repartition(order).sortWithinPartitions(order).drop(order)


def equal_mix_sql(documents: str = "documents", seed: int = 0) -> str:
    """DuckDB SQL for ``mix`` with equal weights over columns doc_id, text, lang, source, n_chars."""
    return f"""
    WITH n AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source),
    t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM n),
    r AS (SELECT source, total * 1.0 / k / n AS rate, greatest(1, ceil(total * 1.0 / k / n / {SPLIT}))::INT AS draws FROM n, t),
    f AS (SELECT source, draws, list_reduce(list_prepend([exp(-rate / draws), exp(-rate / draws)], list_transform(range(1, {TERMS + 1}), lambda k: [k::DOUBLE, rate / draws])),
            lambda a, x: list_concat([a[1] * x[2] / x[1], a[2] + a[1] * x[2] / x[1]], list_concat(a[3:], [a[2] + a[1] * x[2] / x[1]]))) AS a, exp(-rate / draws) AS zero FROM r),
    c AS (SELECT source, draws, list_prepend(zero, a[3:]) AS cdf FROM f),
    u AS (SELECT d.*, c.cdf, unnest(range(1, c.draws + 1)) AS i FROM (SELECT *, row_number() OVER () AS place FROM {documents}) d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
    k AS (SELECT place, doc_id, text, lang, source, n_chars,
            sum(len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':{seed}:' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / {16**13}.0))) AS times
          FROM u GROUP BY ALL)
    SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times::INT + 1))::INT AS copy FROM k"""
