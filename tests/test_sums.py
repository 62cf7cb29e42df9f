import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandspark.operators import sketches, sums
from strandspark.plans import scale_queries


def bits(x):
    return struct.pack(">d", x)


def test_sums_are_exact_in_any_partitioning(spark):
    rng = random.Random(3)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-20, 20) for _ in range(3000)]
    values += [1e308, -1e308, 5e-324, -2.5e-310, 2.0**-1022, 1.0, 2.0**52 + 0.5, 0.1, -0.0, 0.0] * 3
    rows = [(k % 7, v) for k, v in enumerate(values)] + [(0, None), (9, None)]
    want = {g: math.fsum(v for k, v in rows if k == g and v is not None) for g in range(7)}
    seen = set()
    for parts in (1, 4, 16):
        df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
        got = {r["g"]: (r["total"], r["n"]) for r in sums.exact_sums(df, ["g"], "v").collect()}
        assert {g: bits(t) for g, (t, _) in got.items()} == {g: bits(t) for g, t in want.items()}
        seen.add(tuple(sorted(got.items())))
    assert len(seen) == 1 and sum(n for _, n in got.values()) == len(values)


def test_each_value_alone_comes_back(spark):
    rng = random.Random(5)
    values = [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    values = [v for v in values if math.isfinite(v)] + [2.0**k for k in range(-1074, 1024)] + [5e-324 * k for k in range(1, 40)]
    df = spark.createDataFrame(list(enumerate(values)), "g int, v double")
    got = {r["g"]: r["total"] for r in sums.exact_sums(df, ["g"], "v").collect()}
    assert [got[k] for k in range(len(values))] == values


def test_specials_merging_and_nothing(spark):
    inf = math.inf
    df = spark.createDataFrame([("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", math.nan), ("d", -inf), ("e", 1e308), ("e", 1e308)], "g string, v double")
    got = {r["g"]: r["total"] for r in sums.exact_sums(df, ["g"], "v").collect()}
    assert got["a"] == inf and math.isnan(got["b"]) and math.isnan(got["c"]) and got["d"] == -inf and got["e"] == inf
    one, two = spark.createDataFrame([("x", 0.1), ("y", 3.0)], "g string, v double"), spark.createDataFrame([("x", 0.2), ("x", -0.3)], "g string, v double")
    both = sums.merge_sums(sums.partial_sums(one, ["g"], "v").unionByName(sums.partial_sums(two, ["g"], "v")), ["g"])
    assert {r["g"]: (r["total"], r["n"]) for r in sums.finish_sums(both, ["g"]).collect()} == {"x": (math.fsum([0.1, 0.2, -0.3]), 3), "y": (3.0, 1)}
    assert sums.exact_sums(df.limit(0), ["g"], "v").collect() == []


def test_values_are_added_before_their_parts_become_rows(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 2.0), ("b", 0.0), ("b", -1e-300)], "g string, v double")
    partial = sums.partial_sums(df, ["g"], "v")
    below = partial._jdf.queryExecution().optimizedPlan().toString().split("Generate")
    assert len(below) == 2 and "Aggregate" in below[1]
    rows = [r.asDict() for r in partial.collect()]
    assert {r["g"]: r["n"] for r in rows if r["bin"] is None} == {"a": 2, "b": 2} and all(r["n"] == 0 and r["units"] != 0 for r in rows if r["bin"] is not None)


def test_no_dealing_of_the_query_is_of_a_fixed_number_of_tasks(spark):
    plan = scale_queries.exact_sums(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan


def test_studentise_is_the_same_under_any_partitioning(spark):
    rng = random.Random(7)
    rows = [(f"r{k % 5}", k, rng.gauss(1e6, 1.0)) for k in range(2000)] + [("flat", 0, 3.0), ("flat", 1, 3.0)]
    out = []
    for parts in (1, 5, 13):
        df = spark.createDataFrame(rows, "read_id string, idx long, value double").repartition(parts)
        out.append({(r["read_id"], r["idx"]): r["value"] for r in sums.studentise_exact(df).collect()})
    assert out[0] == out[1] == out[2] and out[0]["flat", 0] is None
    own = [v for (g, _), v in out[0].items() if g == "r1"]
    assert abs(math.fsum(own)) < 1e-5 and math.fsum(v * v for v in own) / len(own) == pytest.approx(1.0)


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(9)
    rows = [(k % 3, k % 50, rng.lognormvariate(0, 2)) for k in range(60_000)] + [(0, 0, None), (0, 0, math.nan)]
    df = spark.createDataFrame(rows, "read_id int, chunk int, value double").repartition(8)
    fine = sketches.sketch(df, ["read_id", "chunk"])
    merged = sketches.merge(sketches.merge(fine, ["read_id"]), [])
    values = sorted(v for _, _, v in rows if v is not None and not math.isnan(v))
    for p in (0.01, 0.25, 0.5, 0.9, 0.999):
        r = merged.select(sketches.quantile(p).alias("q"), "n").first()
        below = sum(v < r["q"] for v in values) / len(values)
        assert r["n"] == len(values) and abs(below - p) <= 2 * sketches.rank_error()
    size = fine.agg(F.max(F.length("sketch"))).first()[0]
    assert size < 20_000
    few = [v for _, _, v in rows[:101]]
    small = spark.createDataFrame([(v,) for v in few], "value double")
    assert sketches.sketch(small, []).select(sketches.quantile(0.5)).first()[0] == sorted(few)[50]
