import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.operators import chain, scan

TOPOLOGIES = [chain.flip_flop(2), chain.run_length(3), chain.run_length_v1(4)]


def reads(t, lengths, seed):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(size=(n, t.n_weight)) for k, n in enumerate(lengths)}


def table(spark, made):
    rows = [(k, b, w.tolist()) for k, ws in made.items() for b, w in enumerate(ws)]
    return spark.createDataFrame(rows, "read_id long, blk long, w array<double>").repartition(3)


@pytest.mark.parametrize("t", TOPOLOGIES, ids=lambda t: t.name)
def test_ranges_give_what_whole_reads_give(spark, t):
    made = reads(t, [1, 2, 3, 4, 5, 17, 40], 1)
    blocks = table(spark, made)
    z = {r["read_id"]: r["log_z"] for r in scan.partition_by_ranges(blocks, t, 3, 2).collect()}
    best = {r["read_id"]: r["score"] for r in scan.score_by_ranges(blocks, t, 3, 2).collect()}
    paths, posts = {}, {}
    for r in scan.decode_by_ranges(blocks, t, 3, 2).collect():
        paths.setdefault(r["read_id"], {})[r["pos"]] = (r["state"], r["q"], r["score"])
    for r in scan.posteriors_by_ranges(blocks, t, size=3, fan=2).collect():
        posts.setdefault(r["read_id"], {})[r["blk"]] = r["w"]
    assert set(z) == set(best) == set(paths) == set(posts) == set(made)
    for k, w in made.items():
        score, path, step = chain.viterbi(w, t)
        assert z[k] == pytest.approx(chain.partition(w, t), abs=1e-9) and best[k] == pytest.approx(score, abs=1e-9)
        assert sorted(paths[k]) == list(range(len(w) + 1)) and [paths[k][p][0] for p in range(len(w) + 1)] == path.tolist()
        assert paths[k][0][1] is None and [paths[k][p + 1][1] for p in range(len(w))] == pytest.approx(step.tolist())
        assert all(v[2] == pytest.approx(score) for v in paths[k].values())
        assert np.allclose([posts[k][b] for b in range(len(w))], chain.step_posteriors(w, t), atol=1e-9)


def test_of_equal_paths_one_is_whole(spark):
    t = chain.flip_flop(2)
    blocks = table(spark, {0: np.zeros((11, t.n_weight))})
    found = sorted(scan.decode_by_ranges(blocks, t, 2, 2).collect(), key=lambda r: r["pos"])
    steps = {(s, to) for to, choices in enumerate(t.steps) for s, _ in choices}
    states = [r["state"] for r in found]
    assert len(states) == 12 and all(p in steps for p in zip(states, states[1:])) and found[0]["score"] == 0


def test_no_row_holds_a_whole_read(spark):
    t = chain.flip_flop(2)
    blocks = table(spark, reads(t, [50], 2))
    assert scan.block_ranges(blocks, 8).agg(F.max(F.size("ws"))).first()[0] == 8
    _, levels = scan.sweep_up(blocks, t, scan._sum, 8, 2)
    assert [x.count() for x in levels] == [7, 4, 2, 1]
    assert scan.partition_by_ranges(blocks.limit(0), t).collect() == []
