import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.sources import fast5, tables, text

RUNS = "read_id string, run_idx int, base string, shape double, scale double, dwell int"


def test_run_records_round_trip(spark, tmp_path):
    rows = [("a-1", 0, "A", 1.5, 2.25, 3), ("a-1", 1, "C", 1.0, 0.5, 1), ("b#2", 0, "T", 2.0, 9.0, 12)]
    runs = spark.createDataFrame(rows, RUNS)
    text.write_records(text.run_records(runs), str(tmp_path / "runs"))
    back = text.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(tuple(r) for r in back.collect()) == rows
    (tmp_path / "empty.run").write_text("")
    assert text.read_runs(spark, str(tmp_path / "empty.run")).count() == 0
    (tmp_path / "none.run").write_text("# lonely\n")
    assert text.read_runs(spark, str(tmp_path / "none.run")).count() == 0


def test_matrices_round_trip(spark, tmp_path):
    m = np.random.default_rng(0).uniform(-1, 1, (9, 5)).tolist()
    frame = spark.createDataFrame([("m", 5, 9, m)], "name string, nr int, nc int, data array<array<double>>")
    record = text.matrix_records(frame).first()["record"]
    (tmp_path / "m.crp").write_text(record)
    (tmp_path / "bad.crp").write_text("2\t2\n0x1p+0\n")
    got = {r["name"]: r for r in text.read_matrices(spark, str(tmp_path / "*.crp")).collect()}
    assert got["m.crp"]["data"] == m and (got["m.crp"]["nr"], got["m.crp"]["nc"]) == (5, 9)
    assert got["bad.crp"]["data"] is None


CALLS = "read_id string, filename string, basecall string, quality string, score double, nblock long, sequence_length int, nsample long, trim_start long, trim_end long"


def test_records(spark):
    calls = spark.createDataFrame([("u", "f.fast5", "ACGT", "!!!!", -8.0, 4, 4, 99, 5, 90), ("e", "g", "", "", 0.0, 0, 0, 1, 0, 0)], CALLS)
    head = '{ "filename" : "f.fast5", "uuid" : "u", "normalised_score" : 2.000000,  "nblock" : 4,  "sequence_length" : 4,  "blocks_per_base" : 1.000000, "nsample" : 99, "trim" : [ 5, 90 ] }'
    one = lambda kind: text.format_calls(calls, kind, "p_").where("read_id = 'u'").first()["record"]
    assert one("fasta") == f">p_u  {head}\nACGT"
    assert one("fastq") == f"@p_u  {head}\nACGT\n+\n!!!!"
    assert text.format_calls(calls, "sam", by_uuid=False).where("read_id = 'u'").first()["record"].startswith("f.fast5\t4")
    assert one("sam") == "p_u\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t!!!!"
    empty = text.format_calls(calls, "fasta").where("read_id = 'e'").first()["record"]
    assert '"blocks_per_base" : null' in empty
    with pytest.raises(ValueError):
        text.format_calls(calls, "FASTQ")


def test_wrapping(spark):
    seqs = spark.createDataFrame([("a", "A" * 120), ("b", "C" * 61), ("c", "")], "read_id string, sequence string")
    got = {r["read_id"]: r["record"] for r in text.wrapped_fasta(seqs).collect()}
    assert got == {"a": ">a\n" + "A" * 60 + "\n" + "A" * 60, "b": ">b\n" + "C" * 60 + "\nC"}


def test_options():
    assert text.parse_trim("200:10") == (200, 10) and text.parse_trim("7") == (7, 7)
    assert text.parse_segmentation("100:25") == (100, 0.25)


def test_fast5_files_that_cannot_be_read_become_error_rows(spark, tmp_path):
    (tmp_path / "b.fast5").write_text("not hdf5")
    (tmp_path / "a.fast5").write_text("")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.fast5").write_text("")
    assert [p.rsplit("/", 1)[-1] for p in fast5.expand(str(tmp_path))] == ["a.fast5", "b.fast5"]
    rows = fast5.read_fast5(spark, str(tmp_path)).collect()
    assert sorted(r["filename"] for r in rows) == ["a.fast5", "b.fast5"] and all(r["error"] for r in rows)
    assert fast5.read_fast5(spark, str(tmp_path / "nothing*")).count() == 0


def test_calibration(spark):
    rows = [("r", "f", 2, 8192.0, 16.0, 1373.41, 4000.0, [0.0, 100.0], None), ("q", "f", 1, None, None, None, None, [5.0], None)]
    got = {r["read_id"]: r for r in fast5.calibrated(spark.createDataFrame(rows, fast5.READS)).collect()}
    assert np.allclose(got["r"]["raw"], [16 * 1373.41 / 8192, 116 * 1373.41 / 8192])
    assert got["q"]["raw"] == [5.0] and got["q"]["error"] == "no_calibration"


def test_traces_and_random_matrices(spark, tmp_path):
    traces = spark.createDataFrame([("r", [0.5, 1.0], [[255, 0], [51, 204]])], "read_id string, signal array<double>, trace array<array<long>>")
    for _ in range(2):
        tables.write_traces(traces, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    points = tables.trace_points(traces).where("pos = 1").orderBy("state").collect()
    assert [r["probability"] for r in points] == [0.2, 0.8]
    m = tables.random_matrix(spark, 3, 50, -2.0, 5.0, 1).select(F.explode("data").alias("x")).agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert -2 <= m[0] < m[1] <= 5 and m[2] == 150
