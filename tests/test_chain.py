import itertools

import numpy as np
import pytest

from strandspark.operators import chain

TOPOLOGIES = [chain.flip_flop(2), chain.flip_flop_states(2), chain.run_length(2), chain.run_length_v1(2), chain.flip_flop(3)]


def all_paths(w, t):
    """(path, weights used, score) of every path."""
    reach = [{s: [r for a, r in c if a == s] for s, _ in c} for c in t.steps]
    for p in itertools.product(range(t.n_state), repeat=len(w) + 1):
        if all(p[k] in reach[p[k + 1]] for k in range(len(w))):
            rows = [reach[p[k + 1]][p[k]][0] for k in range(len(w))]
            yield p, rows, sum(w[k, r] for k, r in enumerate(rows))


@pytest.mark.parametrize("t", TOPOLOGIES, ids=lambda t: f"{t.name}{t.n_state}")
@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_kernels_equal_path_enumeration(t, blocks):
    w = np.random.default_rng(blocks).normal(0, 1, (blocks, t.n_weight))
    paths = list(all_paths(w, t))
    scores = np.array([s for *_, s in paths])
    score, path, step = chain.viterbi(w, t)
    assert score == pytest.approx(scores.max()) and tuple(path) == paths[int(scores.argmax())][0]
    assert step.sum() == pytest.approx(score)
    log_z = np.log(np.exp(scores).sum())
    f, b = chain.forward_backward(w, t)
    assert chain.partition(w, t) == pytest.approx(log_z) and chain._lse(b[0], 0) == pytest.approx(log_z)
    assert score <= log_z
    post = chain.step_posteriors(w, t)
    share = np.zeros(w.shape)
    states = np.zeros((blocks + 1, t.n_state))
    for p, rows, s in paths:
        for k, row in enumerate(rows):
            share[k, row] += np.exp(s - log_z)
        for k, x in enumerate(p):
            states[k, x] += np.exp(s - log_z)
    used = sorted({r for c in t.steps for _, r in c})
    assert np.allclose(np.exp(post[:, used]), share[:, used])
    assert np.allclose(np.exp(post[:, used]).sum(1), 1)
    assert np.allclose(chain.state_posteriors(w, t, log=False), states)
    if t.name != "flip_flop_states":
        assert len(used) == sum(len({r for _, r in c}) for c in t.steps)


def test_trace_rows_are_state_shares():
    t = chain.flip_flop(2)
    w = np.random.default_rng(0).normal(0, 1, (6, t.n_weight))
    got = chain.trace(chain.step_posteriors(w, t), t)
    assert got.shape == (7, 4) and (np.abs(got.sum(1) - 255) <= 3).all()
    assert np.abs(got - 255 * chain.state_posteriors(w, t, log=False)).max() <= 1


def test_ties():
    t = chain.flip_flop(2)
    _, path, _ = chain.viterbi(np.zeros((3, t.n_weight)), t)
    assert path.tolist() == [0, 0, 0, 0]
    assert t.steps[2][0][0] == 2 and chain.flip_flop_states(2).steps[2][0][0] == 0
    assert chain.run_length(2).steps[2][0][0] == 0


def test_spark_operators(spark):
    t = chain.run_length(2)
    rng = np.random.default_rng(1)
    reads = {1: rng.normal(0, 1, (5, t.n_weight)), 2: rng.normal(0, 1, (1, t.n_weight))}
    rows = [(k, b, w.tolist()) for k, m in reads.items() for b, w in enumerate(m)]
    blocks = spark.createDataFrame(rows[::-1], "read_id int, blk long, w array<double>")
    scores = {r["read_id"]: r["score"] for r in chain.viterbi_scores(blocks, t).collect()}
    zs = {r["read_id"]: r["log_z"] for r in chain.log_partitions(blocks, t).collect()}
    for k, m in reads.items():
        s, path, _ = chain.viterbi(m, t)
        assert scores[k] == pytest.approx(s) and zs[k] == pytest.approx(chain.partition(m, t))
        got = chain.decode(blocks, t).where(f"read_id = {k}").orderBy("pos").collect()
        assert [r["state"] for r in got] == path.tolist() and got[0]["q"] is None
        assert chain.run_path(chain.decode(blocks, t), 2).where(f"read_id = {k}").count() == len(m)
    assert chain.decode(blocks.limit(0), t).count() == 0
