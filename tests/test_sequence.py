import math

import pytest
from pyspark.sql import functions as F

from strandspark.functions import quality
from strandspark.operators import sequence

LETTERS, LENGTHS = "CACTGTACGCTAGTCTCTCACTGCATGTA", [1, 1, 2, 7, 1, 1, 2, 1, 1, 1, 1, 3, 1, 1, 1, 1, 1, 4, 1, 3, 1, 2, 1, 1, 1, 5, 1, 1, 2]


def path(spark, states, qs=None):
    rows = [("r", k, s, (qs[k] if qs else -0.1 * k) if k else None, 1.0 + k, 2.0 + k) for k, s in enumerate(states)]
    return spark.createDataFrame(rows, "read_id string, pos long, state int, q double, shape double, scale double")


def test_run_length_compression(spark):
    text = "".join(c * n for c, n in zip(LETTERS, LENGTHS))
    assert text == "CACCTTTTTTTGTAACGCTAAAGTCTCTTTTCAAACTTGCATTTTTGTAA"
    letters, lengths = sequence.compress(F.col("t"))
    rows = spark.createDataFrame([(text,), ("",), ("\n\na",)], "t string").select(letters.alias("l"), lengths.alias("n")).collect()
    assert [tuple(r) for r in rows] == [(LETTERS, LENGTHS), ("", []), ("\na", [2, 1])]


def test_changes_and_emission(spark):
    p = path(spark, [0, 0, 4, 1, 1, 3, 2])
    assert [r["pos"] for r in sequence.change_positions(p).orderBy("pos").collect()] == [2, 3, 5, 6]
    assert sequence.change_counts(p).first()["changes"] == 4
    assert sequence.collapse_repeats(p, 4).first()["sequence"] == "AACTG"
    called = sequence.emit_bases(p, 4).first()
    phred = lambda q: chr(min(126, math.floor(33 - 10 * math.log10(1 - min(math.exp(q), 0.99999)) + 0.5)))
    assert called["basecall"] == "ACT" and called["quality"] == "".join(phred(-0.1 * k) for k in (2, 3, 5))
    assert sequence.emit_bases(p, 4, edges=True).first()["basecall"] == "AACTG"
    assert sequence.emit_bases(p, 4, reverse=True).first()["basecall"] == "TCA"
    assert sequence.emit_bases(path(spark, [1]), 4).count() == 0


def test_runs(spark):
    runs = sequence.emit_runs(path(spark, [5, 4, 0, 4, 4, 2, 1, 5]), 4).orderBy("run_idx").collect()
    assert [tuple(r) for r in runs] == [("r", 0, "A", 3.0, 4.0, 3), ("r", 1, "G", 6.0, 7.0, 1), ("r", 2, "C", 7.0, 8.0, 2)]
    table = spark.createDataFrame([("r", 0, "A", 1.5, 2.95, 1), ("r", 1, "C", 1.0, 0.2, 1), ("r", 2, "G", 3.0, 4.9, 2)], "read_id string, run_idx int, base string, shape double, scale double, dwell int")
    assert sequence.decode_runs(table).first()["sequence"] == "AAAC" + "G" * 5
    assert sequence.decode_runs(table, expand=False).first()["sequence"] == "ACG"
    assert sequence.decode_runs(table, mode="weibull").first()["sequence"][0] == "A"


def test_phred_is_capped(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (0.9,), (1.0,), (2.0,)], "p double").select(quality.phred(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["!", "$", "+", "S", "S"]


@pytest.mark.parametrize("n,want", [(12, 2), (24, 3), (40, 4), (60, 5)])
def test_bases_of_weights(spark, n, want):
    assert spark.range(1).select(quality.n_base_of_weights(F.lit(n))).first()[0] == want


def test_path_basecall_repeats_moves_only(spark):
    rows = [("a", 0, 0, 2), ("a", 1, -1, 9), ("a", 2, 3, 0), ("a", 3, 1, 3), ("b", 0, -1, 1)]
    path = spark.createDataFrame(rows, "read_id string, pos int, state int, length int")
    assert {r["read_id"]: r["sequence"] for r in sequence.path_basecall(path, 4).collect()} == {"a": "AATCCC", "b": ""}


def test_run_lengths_of_odd_texts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, "aab"), (1, ""), (2, None), (3, "\u00e9\u00e9\U0001f600\U0001f600x\n\n")], "id int, t string")
    letters, lengths = sequence.compress(F.col("t"))
    got = {r["id"]: (r["a"], r["b"]) for r in rows.select("id", letters.alias("a"), lengths.alias("b")).collect()}
    assert got == {0: ("ab", [2, 1]), 1: ("", []), 2: (None, None), 3: ("\u00e9\U0001f600x\n", [2, 2, 1, 2])}
