import io
import os
import random

import pytest
from pyspark.sql import functions as F

from strandspark.plans import scale_queries
from strandspark.sources import files, records, text


def run_text(rng, names):
    return "".join(f"# {n}\n" + "".join(f"{rng.choice('ACGT')}\t{rng.random():.6f}\t{rng.random():.6f}\t{rng.randint(1, 9)}\n" for _ in range(rng.randint(0, 5))) for n in names)


def rows_of(content):
    out, name = [], None
    for line in content.splitlines():
        if line.startswith("#"):
            name, k = line[2:], 0
        elif line:
            b, a, c, d = line.split("\t")
            out.append((name, k, b, float(a), float(c), int(d)))
            k += 1
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_every_record_is_in_one_range(block):
    rng = random.Random(block)
    for _ in range(60):
        content = run_text(rng, [rng.choice(["a", "b # c", "## d", "x" * 30, ""]) for _ in range(rng.randint(0, 7))])
        content = content if rng.random() < 0.7 else content.rstrip("\n")
        f, n = io.BytesIO(content.encode()), len(content)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(4))})
        got = [x for a, b in zip(cuts, cuts[1:]) for name, lines in records.records_in(f, a, b, n, block) for x in records.run_rows(name, lines)]
        assert sorted(got) == rows_of(content)
        starts = list(records.record_starts(f, 0, n, block))
        assert records.last_start(f, n, block) == (starts[-1] if starts else 0)


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


def test_a_short_range_reads_little_beyond_itself():
    content = run_text(random.Random(2), map(str, range(20_000)))
    f, n = Counting(content.encode()), len(content)
    got = [x for k in range(0, n, 4096) for name, lines in records.records_in(f, k, min(k + 4096, n), n) for x in records.run_rows(name, lines)]
    assert sorted(got) == rows_of(content) and n > 1 << 20 and f.got < 4 * n


def test_short_ranges_of_much_data_get_longer(tmp_path):
    content = run_text(random.Random(4), map(str, range(9000)))
    (tmp_path / "a.run").write_text(content)
    (tmp_path / "b.run").write_text(content[:5000])
    stream = records.RunStreamReader({"path": str(tmp_path), "split_bytes": "16", "closed": "true"})
    for found in (records.RunReader({"path": str(tmp_path), "split_bytes": "16"}).partitions(), stream.partitions(stream.initialOffset(), stream.latestOffset())):
        assert records.RANGES <= len(found) <= records.RANGES + 2
        for name, size in (("a.run", len(content)), ("b.run", 5000)):
            own = [x for x in found if x.path.endswith(name)]
            assert [x.start for x in own] == [0, *(x.stop for x in own[:-1])] and own[-1].stop == size
    assert max(x.stop - x.start for x in records.ranges([("x", 0, 1 << 36)], 4096)) == records.SPLIT_BYTES


def test_records_are_written_by_as_many_tasks_as_there_are_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        place = scale_queries._run_folder(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(records.manifests(place)) == 2 and all(len(m["files"]) > 2 for m in records.manifests(place))


def written(spark, place, rows, mode="append", **options):
    df = spark.createDataFrame(rows, "record string, k int").repartition(3, "k")
    df.write.format("strand_records").options(**options).mode(mode).save(place)


def contents(place):
    return sorted(x for m in records.manifests(place) for f in m["files"] for x in open(f"{place}/{f['name']}").read().split("\n") if x)


def test_jobs_append_overwrite_and_exclude(spark, tmp_path):
    records.register(spark)
    place = str(tmp_path / "out")
    written(spark, place, [(f"a{k}", k) for k in range(9)], exclusive="true")
    written(spark, place, [("b", 1), (None, 2)])
    assert contents(place) == sorted([f"a{k}" for k in range(9)] + ["b"]) and len(records.manifests(place)) == 2
    assert [m["number"] for m in records.manifests(place)] == [1, 2] and sum(f["records"] for m in records.manifests(place) for f in m["files"]) == 10
    with pytest.raises(Exception, match="has records already"):
        written(spark, place, [("c", 1)], exclusive="true")
    written(spark, place, [("d", 1)], "overwrite")
    assert contents(place) == ["d"] and sorted(n for n in os.listdir(place) if not n.startswith("_")) == [f["name"] for f in records.manifests(place)[0]["files"]]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    records.register(spark)
    place = str(tmp_path / "out")
    written(spark, place, [("kept", 1)])
    before = sorted(os.listdir(place))
    bad = F.udf(lambda k: 1 // (k - 5) and "x", "string")
    df = spark.range(12).repartition(4, "id").select(bad("id").alias("record"))
    with pytest.raises(Exception, match="ZeroDivision"):
        df.write.format("strand_records").mode("append").save(place)
    assert sorted(os.listdir(place)) == before and contents(place) == ["kept"]


def test_runs_are_read_by_ranges_and_as_a_stream(spark, tmp_path):
    records.register(spark)
    rng = random.Random(3)
    place = tmp_path / "runs"
    place.mkdir()
    parts = [run_text(rng, [f"r{f}.{k} # same" for k in range(6)]) for f in range(2)]
    (place / "a.run").write_text(parts[0])
    half = parts[1].index("# r1.3")
    (place / "b.run").write_text(parts[1][: half + 9])

    def arrived(**options):
        stream = spark.readStream.format("strand_runs").option("split_bytes", 64).options(**options).load(str(place))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    whole = [x for x in rows_of(parts[0]) if not x[0].startswith("r0.5")] + [x for x in rows_of(parts[1]) if x[0] < "r1.3"]
    assert arrived() == sorted(whole)
    (place / "b.run").write_text(parts[1])
    assert arrived(closed="true") == sorted(rows_of(parts[0]) + rows_of(parts[1]))
    read = spark.read.format("strand_runs").option("split_bytes", 50).load(str(place))
    assert read.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, read.collect())) == sorted(rows_of(parts[0]) + rows_of(parts[1]))


def test_text_reader_cuts_at_lines_only(spark, tmp_path):
    content = "# one # two\nA\t1.0\t2.0\t3\n# three\nC\t1.5\t2.5\t1\nG\t0.5\t0.25\t2\n"
    (tmp_path / "x.run").write_text(content)
    got = sorted(map(tuple, text.read_runs(spark, str(tmp_path)).collect()))
    assert got == rows_of(content)


def test_files_small_large_and_bad(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.dat").write_bytes(b"x" * (10 * k) if k != 3 else b"bad")
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "g.dat").write_text("abc")

    def parse(name, f):
        data = f.read()
        if data == b"bad":
            raise ValueError("not a file of ours")
        yield len(data), data[:1].decode() or None

    found = files.read_files(spark, f"file://{tmp_path}", parse, "n long, first string", "*.dat", large=25)
    got = sorted(((r["filename"], r["n"], r["first"], r["error"]) for r in found.collect()), key=str)
    assert got.pop(0) == ("f0.dat", None, None, "EOFError: the file is empty")
    assert got == [(f"f{k}.dat", *((None, None, "ValueError: not a file of ours") if k == 3 else (10 * k, "x" if k else None, None))) for k in range(1, 6)]
    assert [r["length"] for r in files.list_files(spark, str(tmp_path), "*.dat").orderBy("path").collect()] == [10, 20, 3, 40, 50]
    assert files.list_files(spark, str(tmp_path), "*.dat", below=True).count() == 6
    assert "content" not in files.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
