import pytest

from strandspark.functions import expand
from strandspark.operators import network
from strandspark.plans import basecall
from strandspark.sources import fast5

RUNS = "read_id string, run_idx int, base string, scale double, other int"


def test_bases_of_runs_in_order(spark):
    rows = [("a", 1, "C", 2.9, 0), ("a", 0, "A", 0.2, 0), ("b", 0, "G", 3.0, 0), ("a", 2, None, 9.0, 0), ("a", 3, "T", None, 0), (None, 0, "A", 1.0, 0)]
    got = sorted((tuple(r) for r in expand.expanded(spark.createDataFrame(rows, RUNS).repartition(3)).collect()), key=str)
    assert got == sorted([("a", 0, 0, "A"), ("a", 1, 1, "C"), ("a", 2, 1, "C"), ("a", 3, 3, "T"), ("b", 0, 0, "G"), ("b", 1, 0, "G"), ("b", 2, 0, "G"), (None, 0, 0, "A")], key=str)
    assert expand.expanded(spark.createDataFrame([], RUNS)).count() == 0


def test_wrong_tables_and_factors_are_told(spark):
    runs = spark.createDataFrame([("a", 0, "A")], "read_id string, run_idx int, base string")
    with pytest.raises(Exception, match="needs columns scale"):
        expand.expanded(runs)
    with pytest.raises(Exception, match="positive factor"):
        expand.expanded(spark.createDataFrame([], RUNS), 0.0)


def test_a_limit_counts_failed_files_too(spark):
    signal = [float((k * 37) % 101) for k in range(400)]
    rows = [(None, "a.fast5", None, "OSError: bad"), ("r2", "b.fast5", signal, None), ("r1", "c.fast5", signal, None)]
    reads = spark.createDataFrame(rows, "read_id string, filename string, raw array<float>, error string")
    weights = network.synthetic_weights("flip_flop5", 4)
    called = lambda n: [r["filename"] for r in basecall.basecall(reads, weights, limit=n, trim=(20, 10), segmentation=(20, 0.0)).collect()]
    assert called(1) == [] and called(2) == ["b.fast5"] and sorted(called(0)) == ["b.fast5", "c.fast5"]
    assert {r["filename"] for r in basecall.with_signal(reads, 2).collect()} == {"b.fast5"}


def test_files_are_listed_by_spark_and_bad_ones_are_rows(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.fast5").write_text("no HDF5")
    (tmp_path / "other.txt").write_text("x")
    found = fast5.read_fast5(spark, f"file://{tmp_path}").collect()
    assert sorted(r["filename"] for r in found) == ["a.fast5", "b.fast5", "c.fast5"] and all(r["error"] and r["raw"] is None for r in found)
    assert sorted(r["filename"] for r in fast5.read_fast5(spark, str(tmp_path), limit=2).collect()) == ["a.fast5", "b.fast5"]
    assert [r["filename"] for r in fast5.read_traces(spark, f"{tmp_path}/c.fast5").collect()] == ["c.fast5"]
