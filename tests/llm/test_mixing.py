import math

import duckdb
import pytest
from helpers import docs_table
from pyspark.sql import functions as F

from strandspark.llm import mixing


def plain_counts(docs, rate, seed=0):
    import hashlib

    out = {}
    for i, source in docs:
        lam = rate[source]
        draws = max(1, math.ceil(lam / mixing.SPLIT))
        total = 0
        for k in range(1, draws + 1):
            u = int(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5(b't').hexdigest()}:{seed}:{k}".encode()).hexdigest()[:13], 16) / 16**13
            p = s = math.exp(-lam / draws)
            n = 0
            while s <= u:
                n += 1
                p *= lam / draws / n
                s += p
            total += n
        out[(i, source)] = total
    return out


@pytest.mark.parametrize("broadcast", [10_000, 1])
def test_counts_equal_inverted_poisson(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(k, "big" if k % 3 else ("small" if k % 2 else None)) for k in range(300)] + [(1000, "tiny")]
    docs = docs_table(spark, ["t"] * 301, [i for i, _ in rows], [s for _, s in rows])
    n = {s: sum(1 for _, x in rows if x == s) for s in ("big", "small", None, "tiny")}
    want = plain_counts(rows, {s: 301 / 4 / c for s, c in n.items()})
    got = {(r["doc_id"], r["source"]): r["count"] for r in mixing.mix(docs).groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] == r["n"] for r in copies)


def test_equals_sql_and_weights(spark, tmp_path):
    docs = docs_table(spark, [f"text {k}" for k in range(200)], None, [f"s{k % 7 if k % 2 else 0}" for k in range(200)])
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted((x[0], x[5]) for x in db.sql(mixing.equal_mix_sql()).fetchall())
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect()) == want
    only = mixing.mix(docs, {"s1": 1.0, "s2": 3.0}, total=2000)
    n = {r["source"]: r["count"] for r in only.groupBy("source").count().collect()}
    assert set(n) == {"s1", "s2"} and 350 < n["s1"] < 650 and 1300 < n["s2"] < 1700


def test_global_shuffle_and_edges(spark):
    docs = docs_table(spark, ["x"] * 400, list(range(400)), ["a"] * 400).withColumnRenamed("lang", "Copy")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_"]
    ids = [r["doc_id"] for r in out.collect()]
    assert ids != sorted(ids) and sorted(set(ids)) == sorted(set(r["doc_id"] for r in mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {}).count() == 0
    odd = docs_table(spark, [None, "", "same", "same"], [None, 1, 2, 2], [None, None, "b", "b"])
    assert {r["count"] for r in mixing.mix(odd, total=40).where("doc_id = 2").groupBy("copy").count().collect()} <= {2}


def test_rows_of_one_id_are_dealt_out_and_drawn_apart(spark):
    for texts in (["x"] * 400, [f"x{k}" for k in range(400)]):
        docs = docs_table(spark, texts, [None] * 400, ["a"] * 200 + ["b"] * 200)
        out = mixing.mix(docs, {"a": 3.0, "b": 1.0}, total=800)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * sum(r["count"] for r in parts)
    n = mixing.mix(docs).count()
    assert n != 800 and 320 < n < 480
    same = mixing.mix(docs_table(spark, [f"y{k}" for k in range(300)], [7] * 300), total=300)
    assert len({r["count"] for r in same.groupBy("text").count().collect()}) > 2


def test_main_path_has_no_python(spark):
    plan = mixing.mix(docs_table(spark, ["x"] * 10))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
