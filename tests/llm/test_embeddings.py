import numpy as np

from strandspark.llm import embeddings as e


def plain(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in zip(ids, vectors)]
    n = len(ids)
    links, up = [0] * n, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    i, j = sorted((find(a), find(b)), key=lambda k: ids[k])
                    up[j] = i
    return {(ids[k], links[k], ids[find(k)]) for k in range(n)}


def test_equals_brute_force_over_several_leaves(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (40, 8))
    rows = np.vstack([base, base + rng.normal(0, 0.08, (40, 8)), base[:5] * 3, np.tile(base[0], (30, 1))]).astype(np.float32)
    vectors = [v.tolist() for v in rows] + [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [], [1.0, 2.1], [-2.0, 1.0], [3.0], [5.0], [-5.0]]
    ids = list(range(len(vectors)))
    frame = spark.createDataFrame(list(zip(ids, vectors, [0] * len(ids))), "vec_id long, embedding array<float>, label int")
    for leaf in (None, 16):
        got = e.near_duplicates(frame, leaf_rows=leaf).collect()
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == plain(ids, vectors)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and len(got) == len(ids)


def test_repeated_ids_with_other_vectors_stay_apart(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [0.99, 0.01, 0.0]), (7, [0.01, 0.99, 0.0]), (8, [0.0, -0.0, 1.0]), (9, [-0.0, 0.0, 1.0])]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 1, 8), (9, 1, 8)]


def test_one_leaf_beyond_its_bound_is_cut(spark, monkeypatch):
    monkeypatch.setattr(e, "LEAVES", 2)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (60, 8))
    vectors = np.vstack([base, base + rng.normal(0, 0.08, (60, 8))]).tolist()
    got = e.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), leaf_rows=10).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == plain(list(range(120)), vectors)


def test_reached_leaves_are_all_leaves_in_reach():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 3))
    tree = e.Tree(x, 4)
    leaf = tree.leaf(x)
    low, high = (np.stack([f(x[leaf == k], 0) for k in range(16)]) for f in (np.min, np.max))
    got = set(zip(*map(np.ndarray.tolist, e.Boxes(low, high).reached(x, 0.1))))
    gap = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero((gap**2).sum(2) <= 0.1))))


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, n_links string"
    frame = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x")], schema)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in e.near_duplicates(frame).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("None", 0, "None", False)]
    assert e.near_duplicates(frame.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, None, "x")], schema)
    assert [tuple(r) for r in e.near_duplicates(bad).collect()] == [(1, 0, 1, True)]
    huge = spark.createDataFrame([(1, [1e30, 1e-30], "x"), (2, [1e-30, 1e-38], "x"), (3, [0.0, 5.0], "x")], schema)
    assert {(r["vec_id"], r["n_links"]) for r in e.near_duplicates(huge).collect()} == {(1, 1), (2, 1), (3, 0)}
