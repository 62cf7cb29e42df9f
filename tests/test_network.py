import numpy as np
import pytest

from pyspark.sql import functions as F

from strandspark.operators import chain, network, sequence, signal
from strandspark.plans import basecall
from strandspark.sources import tables, text


@pytest.mark.parametrize("width", range(1, 8))
@pytest.mark.parametrize("stride", range(1, 6))
def test_convolution_equals_loop(width, stride):
    rng = np.random.default_rng(width)
    for n in range(width, width + 7):
        x, w, b = rng.normal(0, 1, (n, 2)), rng.normal(0, 1, (width, 2, 3)), rng.normal(0, 1, 3)
        got = network.convolution(x, w, b, stride)
        left = (width - 1) // 2
        want = np.array([[b[k] + sum(w[i, f, k] * x[j * stride + i - left, f] for i in range(width) for f in range(2) if 0 <= j * stride + i - left < n) for k in range(3)] for j in range(-(-n // stride))])
        assert got.shape == want.shape and np.allclose(got, want)


def sig(x):
    return 1 / (1 + np.exp(-x))


@pytest.mark.parametrize("size", [4, 8])
@pytest.mark.parametrize("n", [1, 20])
def test_recurrences_equal_scalar_loops(size, n):
    rng = np.random.default_rng(size + n)
    x3, x4, s3, s4 = rng.normal(0, 1, (n, 3 * size)), rng.normal(0, 1, (n, 4 * size)), rng.normal(0, 1, (size, 3 * size)), rng.normal(0, 1, (size, 4 * size))
    h, c = np.zeros(size), np.zeros(size)
    out = []
    for row in x4:
        p = [row[k] + sum(h[i] * s4[i, k] for i in range(size)) for k in range(4 * size)]
        c = np.array([sig(p[size + k]) * c[k] + sig(p[k]) * np.tanh(p[2 * size + k]) for k in range(size)])
        h = np.array([sig(p[3 * size + k]) * np.tanh(c[k]) for k in range(size)])
        out.append(h)
    assert np.allclose(network.lstm(x4, s4), out)
    for act, f in (("tanh", np.tanh), ("relu", lambda v: np.maximum(v, 0))):
        h, h2, mod, plain = np.zeros(size), np.zeros(size), [], []
        for row in x3:
            p = h @ s3
            z, r = sig(row[:size] + p[:size]), sig(row[size : 2 * size] + p[size : 2 * size])
            h = z * h + (1 - z) * f(r * p[2 * size :] + row[2 * size :])
            mod.append(h)
            g = h2 @ s3[:, : 2 * size]
            z, r = sig(row[:size] + g[:size]), sig(row[size : 2 * size] + g[size:])
            h2 = z * h2 + (1 - z) * f(row[2 * size :] + (r * h2) @ s3[:, 2 * size :])
            plain.append(h2)
        assert np.allclose(network.gru(x3, s3, None, act), mod)
        assert np.allclose(network.gru(x3, s3[:, : 2 * size], s3[:, 2 * size :], act), plain)


@pytest.mark.parametrize("name", network.NETWORKS)
def test_networks_are_globally_normalised(name):
    for n in (1, 37):
        x = np.random.default_rng(n).normal(0, 1, n)
        w = network.run_network(x, name, network.synthetic_weights(name, 3, 6), 3, temperature=1.5)
        t = {"flip_flop": chain.flip_flop, "run_length": chain.run_length, "run_length_v1": chain.run_length_v1}[network.family(name)](3)
        assert w.shape[1] == t.n_weight and chain.partition(w, t) == pytest.approx(0, abs=1e-9)


def reads(spark, n=5, size=300):
    rng = np.random.default_rng(0)
    rows = [(f"r{k}", i, float(v)) for k in range(n) for i, v in enumerate(np.repeat(rng.normal(80, 10, size // 5), 5) + rng.normal(0, 1, size))]
    return spark.createDataFrame(rows + [("short", 0, 1.0)], "read_id string, idx long, value double")


def test_whole_queries(spark):
    weights = network.synthetic_weights("flip_flop5", 4)
    calls = basecall.basecall(reads(spark), weights, trim=(20, 10), segmentation=(20, 0.0)).collect()
    assert len(calls) == 5
    for r in calls:
        assert len(r["basecall"]) == len(r["quality"]) == r["sequence_length"] and set(r["basecall"]) <= set("ACGT")
        assert r["nsample"] == 300 and r["nblock"] == -(-(r["trim_end"] - r["trim_start"]) // 5)
    # the same put together from the operators on samples, blocks and paths
    live = basecall.prepare(reads(spark), (20, 10), (20, 0.0))
    path = chain.decode(network.transitions(signal.to_reads(live), "flip_flop5", weights, 4), chain.flip_flop(4), posterior=True)
    whole = {r["read_id"]: r for r in sequence.emit_bases(path, 4).collect()}
    scores = {r["read_id"]: r["score"] for r in path.collect()}
    for r in calls:
        assert (r["basecall"], r["quality"]) == (whole[r["read_id"]]["basecall"], whole[r["read_id"]]["quality"])
        assert r["score"] == pytest.approx(scores[r["read_id"]], abs=1e-9)
    assert basecall.basecall(reads(spark), weights, limit=2, trim=(20, 10), segmentation=(20, 0.0)).count() == 2
    plain = basecall.basecall(reads(spark), weights, viterbi_only=True, reverse=True, delta=3.0, trim=(20, 10), segmentation=(20, 0.0))
    assert plain.count() == 5
    weights = network.synthetic_weights("run_length5", 4)
    runs = basecall.basecall_runs(reads(spark), weights, trim=(20, 10), segmentation=(20, 0.0)).collect()
    blocks = network.transitions(signal.to_reads(live), "run_length5", weights, 4)
    path = chain.run_path(chain.decode(blocks, chain.run_length(4), posterior=True, normalised=False), 4)
    at = F.pmod("state", F.lit(4)).cast("int")
    params = path.join(blocks.select("read_id", F.col("blk").alias("pos"), "w"), ["read_id", "pos"]).select("read_id", "pos", "state", F.element_at("w", at + 1).alias("shape"), F.element_at("w", at + 5).alias("scale"))
    want = {(r["read_id"], r["run_idx"]): r for r in sequence.emit_runs(params, 4).collect()}
    assert len(want) == len(runs)
    for r in runs:
        w = want[r["read_id"], r["run_idx"]]
        assert (r["base"], r["dwell"]) == (w["base"], w["dwell"]) and r["shape"] == pytest.approx(w["shape"]) and r["scale"] == pytest.approx(w["scale"])
    assert runs and all(r["shape"] >= 1 and r["dwell"] >= 1 and r["base"] in "ACGT" for r in runs)


def test_fastq_and_traces_from_a_table_of_reads(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"id{k}", f"f{k // 2}.fast5", rng.normal(80, 10, 400).round().tolist(), None) for k in range(4)] + [("bad", "x.fast5", None, "OSError"), ("flat", "y.fast5", [3.0] * 400, None)]
    table = spark.createDataFrame(rows, "read_id string, filename string, raw array<double>, error string")
    calls = basecall.basecall(table, network.synthetic_weights("flip_flop5", 4), trace=True, trim=(20, 10), segmentation=(20, 0.0))
    text.write_records(text.format_calls(calls, "fastq", "p_", by_uuid=False), str(tmp_path / "calls"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "calls")).collect()]
    heads = [x for x in lines if x.startswith("@p_")]
    assert sorted(x.split()[0] for x in heads) == ["@p_f0.fast5", "@p_f0.fast5", "@p_f1.fast5", "@p_f1.fast5"]
    assert all('"uuid" : "id' in x and ',  "nblock" : ' in x for x in heads)
    tables.write_traces(calls, str(tmp_path / "traces"))
    back = spark.read.parquet(str(tmp_path / "traces"))
    for r in back.collect():
        assert len(r["trace"]) == -(-len(r["signal"]) // 5) + 1 and all(len(x) == 8 for x in r["trace"])
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan


def test_models_and_weights(spark):
    assert network.model_table(spark).count() == 5
    with pytest.raises(ValueError):
        basecall.basecall(reads(spark), [], model="rle_r941_native")
    with pytest.raises(ValueError):
        basecall.basecall(reads(spark), [], model="unknown")
    weights = network.synthetic_weights("flip_flop_gru", 4, 4)
    back = tables.load_weights(tables.weights_table(spark, "m", weights), "m")
    x = np.linspace(-1, 1, 21)
    assert np.allclose(network.run_network(x, "flip_flop_gru", back, 4), network.run_network(x, "flip_flop_gru", weights, 4))


def test_softmax_layer():
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(0, 1, (3, 4)), rng.normal(0, 1, (4, 5)), rng.normal(0, 1, 5)
    e = np.exp(x @ w + b)
    assert np.allclose(network.softmax(x, w, b), e / e.sum(1, keepdims=True))
    assert np.allclose(network.softmax(x, w, b, 2.0, 3.0).sum(1), 1)
    assert signal.MAD_SCALE == 1.4826


def test_layers_over_tables_of_blocks(spark):
    rng = np.random.default_rng(3)
    m, bias = rng.normal(size=(3, 2)), rng.normal(size=2)
    rows = [("a", k, rng.normal(size=3).tolist()) for k in range(20)] + [("b", 0, None), ("b", 1, [1.0])]
    blocks = spark.createDataFrame(rows, "read_id string, blk long, w array<double>")
    got = {(r["read_id"], r["blk"]): r["w"] for r in network.affine_blocks(blocks, m, bias, "tanh").collect()}
    assert got["b", 0] is None and got["b", 1] is None and len(got) == 22
    for read, k, w in rows[:20]:
        assert got[read, k] == pytest.approx(np.tanh(np.array(w) @ m + bias))
    shares = network.softmax_blocks(blocks.where("read_id = 'a'"), m, bias, 2.0, 1.0).first()["w"]
    assert sum(shares) == pytest.approx(1) and min(shares) > 0
    both = network.add_layers(network.affine_blocks(blocks, m), network.affine_blocks(blocks, m)).where("read_id = 'a' and blk = 0").first()["w"]
    assert both == pytest.approx(2 * (np.array(rows[0][2]) @ m))
    assert network.affine_blocks(blocks.limit(0), m).collect() == []
