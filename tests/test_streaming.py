import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandspark import session
from strandspark.operators import chain
from strandspark.plans import driver_queries
from strandspark.streaming import reads, windows

CHUNKS = "read_id string, seq int, last boolean, values array<double>"


def streamed(spark, folder, batches, schema, plan):
    """Rows in batches, a file each, through a stream that ends when all are read; also how many batches ran."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b={k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = plan(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect(), len(query.recentProgress)


def test_chunks_in_any_order_and_repeated(spark, tmp_path):
    rng = random.Random(1)
    whole = {f"r{k}": [[float(10 * s + i) for i in range(rng.randint(0, 4))] for s in range(rng.randint(1, 6))] for k in range(8)}
    rows = [(k, s, s == len(c) - 1, v) for k, c in whole.items() for s, v in enumerate(c)]
    rows += rng.sample(rows, 6) + [("open", 0, False, [1.0]), ("gap", 1, True, [2.0])]
    rng.shuffle(rows)
    found, batches = streamed(spark, tmp_path, [rows[k::4] for k in range(4)], CHUNKS, reads.assemble_reads)
    got = {r["read_id"]: (r["signal"], r["complete"]) for r in found if r["read_id"] in whole}
    assert got == {k: ([v for x in c for v in x], True) for k, c in whole.items()} and batches >= 4
    assert not {"open", "gap"} & {r["read_id"] for r in found}


def test_chunks_in_any_order_become_reads(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        """Add chunks, and let the stream take what is there, its state kept between runs."""
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(src)
        assembled = reads.assemble_reads(spark.readStream.schema(CHUNKS).parquet(src))
        query = assembled.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(120), "the stream did not end"
        finally:
            query.stop()
        return {r["read_id"]: (r["signal"], r["complete"]) for r in spark.read.parquet(out).collect()}

    got = arrive([("a", 1, False, [3.0]), ("a", 2, True, [4.0, 5.0]), ("b", 0, True, [9.0]), ("c", 1, True, [1.0])])
    assert got == {"b": ([9.0], True)}
    got = arrive([("a", 0, False, [1.0, 2.0]), ("a", 0, False, [1.0, 2.0])])
    assert got == {"a": ([1.0, 2.0, 3.0, 4.0, 5.0], True), "b": ([9.0], True)}


class Values:
    """State and timers of one key, as Spark would hold them."""

    def __init__(self):
        self.lists, self.values, self.timers, self.put_rows = {}, {}, [], 0

    def getListState(self, name, schema, ttl=None):
        rows, outer = self.lists.setdefault(name, []), self

        class List:
            def get(self):
                return iter(rows)

            def exists(self):
                return bool(rows)

            def appendList(self, x):
                rows.extend(x)

            def put(self, x):
                rows[:] = x
                outer.put_rows += len(x)

            def clear(self):
                rows.clear()

        return List()

    def getValueState(self, name, schema, ttl=None):
        held = self.values

        class Value:
            def get(self):
                return held[name]

            def exists(self):
                return name in held

            def update(self, x):
                held[name] = x

            def clear(self):
                held.pop(name, None)

        return Value()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def frame(*chunks):
    import pandas as pd

    return pd.DataFrame(chunks, columns=["seq", "last", "values"])


def test_an_unfinished_read_goes_out_after_its_waiting_time():
    state, work = Values(), reads.ReadAssembler(wait_ms=50)
    work.init(state)
    assert list(work.handleInputRows(("r",), iter([frame((1, True, [2.0]))]), Clock(100))) == [] and state.timers == [150]
    assert list(work.handleInputRows(("r",), iter([frame((2, False, [9.0]))]), Clock(120))) == [] and state.timers == [170]
    out = list(work.handleExpiredTimer(("r",), Clock(170), None))
    assert out[0].iloc[0].tolist() == ["r", [2.0, 9.0], False] and not state.values and not any(state.lists.values())


def test_chunks_are_appended_and_never_written_again():
    state, work = Values(), reads.ReadAssembler()
    work.init(state)
    for k in range(200):
        assert list(work.handleInputRows(("r",), iter([frame((k, False, [float(k)]))]), Clock(0))) == []
    out = list(work.handleInputRows(("r",), iter([frame((200, True, [200.0]))]), Clock(0)))
    assert out[0]["signal"][0] == [float(k) for k in range(201)] and state.put_rows == 0


def test_chunks_that_make_a_read_whole_are_not_written():
    for kind, rows in ((reads.ReadAssembler, lambda *x: [frame(*x)]), (reads.RowAssembler, lambda *x: [Row(seq=s, last=e, values=v) for s, e, v in x])):
        state, work, appended = Values(), kind(), []
        work.init(state)
        work.chunks.appendList, append = lambda x: (appended.extend(x), append(x)), work.chunks.appendList
        out = list(work.handleInputRows(("r",), iter(rows((1, True, [2.0]), (0, False, [1.0]))), Clock(0)))
        assert len(out) == 1 and not appended and not state.values
        assert list(work.handleInputRows(("r",), iter(rows((1, True, [2.0]))), Clock(0))) == [] and len(appended) == 1
        out = list(work.handleInputRows(("r",), iter(rows((0, False, [1.0]), (1, True, [9.0]))), Clock(0)))
        assert len(out) == 1 and len(appended) == 1 and not state.values and not any(state.lists.values())
        assert list(out[0]["signal"] if kind is reads.RowAssembler else out[0]["signal"][0]) == [1.0, 2.0]


def test_an_unfinished_read_goes_out_as_a_row():
    state, work = Values(), reads.RowAssembler(wait_ms=50)
    work.init(state)
    assert list(work.handleInputRows(("r",), iter([Row(seq=1, last=True, values=None)]), Clock(100))) == [] and state.timers == [150]
    assert list(work.handleExpiredTimer(("r",), Clock(150), None)) == [Row(read_id="r", signal=[], complete=False)] and not state.values
    assert list(work.handleExpiredTimer(("r",), Clock(150), None)) == []


def test_the_files_of_the_stream_follow_the_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = driver_queries.streamed_reads(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found and len(list((tmp_path / "chunks").glob("*.parquet"))) == 9 and len([p for p in (tmp_path / "streamed-state" / "commits").iterdir() if p.name.isdigit()]) == 3


def test_partitions_are_folded_over_batches(spark, tmp_path):
    t = chain.flip_flop(2)
    rng = np.random.default_rng(4)
    made = {k: rng.normal(size=(n, t.n_weight)) for k, n in enumerate([1, 4, 13, 30])}
    rows = [(k, b, b == len(w) - 1, w[b].tolist()) for k, w in made.items() for b in range(len(w))]
    random.Random(4).shuffle(rows)
    rows += rows[:5]
    found, _ = streamed(spark, tmp_path, [rows[k::3] for k in range(3)], "read_id long, blk long, last boolean, w array<double>", lambda s: reads.stream_partitions(s, t))
    got = {r["read_id"]: r["log_z"] for r in found}
    assert got == {k: pytest.approx(chain.partition(w, t), abs=1e-9) for k, w in made.items()}


def test_sessions_close_and_late_rows_are_dropped(spark, tmp_path):
    # a batch drops what is behind the watermark that the batch before it began with
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = lambda *x: [(k, at(m), float(v)) for k, m, v in x]
    batches = [rows(("a", 10, 1), ("a", 15, 2), ("b", 12, 3)), rows(("a", 100, 5), ("b", 90, 1)), rows(("q", 101, 0)), rows(("a", 16, 7), ("a", 99, 4)), rows(("z", 900, 0))]
    plan = lambda s: windows.sessions(s.select("k", F.col("t").cast("timestamp").alias("ts"), "value"), "k", "10 minutes", "5 minutes")
    found, _ = streamed(spark, tmp_path, batches, "k string, t string, value double", plan)
    got = sorted((r["k"], r["start"].minute + 60 * r["start"].hour, r["end"].minute + 60 * r["end"].hour, r["n"], r["total"]) for r in found)
    assert got == [("a", 10, 25, 2, 3.0), ("a", 99, 110, 2, 9.0), ("b", 12, 22, 1, 3.0), ("b", 90, 100, 1, 1.0), ("q", 101, 111, 1, 0.0)]


def test_tumbling_and_sliding_mads(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), f"2024-01-01 00:{rng.randrange(60):02d}:00", rng.random()) for _ in range(200)] + [("a", "2024-01-01 00:05:00", None), ("a", "2024-01-01 00:05:00", float("nan"))]
    df = spark.createDataFrame(rows, "k string, t string, value double").select("k", F.col("t").cast("timestamp").alias("ts"), "value")
    for slide in (None, "5 minutes"):
        for r in windows.tumbling_mad(df, "k", "15 minutes", "1 minute", slide).collect():
            values = [v for k, t, v in rows if k == r["k"] and v is not None and v == v and f"{r['start']}" <= t < f"{r['end']}"]
            median = np.median(values)
            assert (r["n"], r["median"], r["mad"]) == (len(values), pytest.approx(median), pytest.approx(1.4826 * np.median(np.abs(np.array(values) - median))))
