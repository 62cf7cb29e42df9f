import numpy as np
import pytest

import strandspark.__main__ as program
from strandspark.operators import network
from strandspark.sources import fast5, records, tables


@pytest.fixture
def reads(spark, monkeypatch):
    """Files as rows, as the source gives them; the first one is bad."""
    rng = np.random.default_rng(2)
    rows = [(None, "a.fast5", None, None, None, None, None, None, "OSError: bad")]
    rows += [(f"r{k}", f"{n}.fast5", 400, 8192.0, 16.0, 1373.0, 4000.0, [float(x) for x in rng.normal(400, 60, 400)], None) for k, n in enumerate("bc")]
    df = spark.createDataFrame(rows, fast5.READS)
    asked = []

    def read(spark, path, first_only=True, limit=0):
        asked.append((path, limit))
        return df.orderBy("filename").limit(limit) if limit else df

    monkeypatch.setattr(fast5, "read_fast5", read)
    return asked


@pytest.fixture
def weights(spark, tmp_path):
    place = str(tmp_path / "weights")
    for m in ("r941_native", "rle_r941_native"):
        net, n_base, _ = network.MODELS[m]
        tables.weights_table(spark, m, network.synthetic_weights(net, n_base)).write.mode("append").parquet(place)
    return place


def test_calls_to_a_folder_and_to_standard_output(spark, reads, weights, tmp_path, capsys):
    options = ["--weights", weights, "--trim", "20:10", "--segmentation", "20:0"]
    out, traces = str(tmp_path / "calls"), str(tmp_path / "traces")
    assert program.main(["basecall", "x", "y", *options, "-f", "sam", "-p", "pre_", "-o", out, "-T", traces], spark) == 0
    found = [x.split("\t") for m in records.manifests(out) for f in m["files"] for x in open(f"{out}/{f['name']}").read().splitlines()]
    assert sorted(x[0] for x in found) == ["pre_r0", "pre_r1"] and all(set(x[9]) <= set("ACGT*") for x in found)
    assert spark.read.parquet(traces).count() == 2 and reads == [(["x", "y"], 0)]
    program.main(["basecall", "x", *options, "--no-uuid", "--limit", "2", "--reverse"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 4 and lines[0].startswith("@b.fast5  {") and reads[-1] == ("x", 2)
    program.main(["runs", "x", *options, "-o", str(tmp_path / "runs")], spark)
    program.main(["decode", str(tmp_path / "runs") + "/*.run", "--rlc"], spark)
    assert capsys.readouterr().out.count(">") == 2


def test_models_and_wrong_options(capsys):
    assert program.main(["basecall", "-m", "help"]) == 0
    told = capsys.readouterr().out
    assert "r941_native" in told and "(default)" in told and "rle_" not in told
    for bad in (["basecall", "x"], ["basecall", "x", "--temperature", "0"], ["runs", "x", "--trim", "-1:3"], ["decode", "f", "--width", "0"], ["basecall", "x", "-f", "BAM"], ["basecall", "x", "--segmentation", "0:5"]):
        with pytest.raises(SystemExit):
            program.main(bad)
