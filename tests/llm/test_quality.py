import math
import random

import numpy as np
import pytest
from helpers import docs_table

from strandspark.llm import quality


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4)))
    good = [" ".join(word() for _ in range(rng.randint(20, 200))).capitalize() + "." for _ in range(n)]
    bad = [" | ".join(word() + "###" for _ in range(rng.randint(20, 200))) for _ in range(n // 2)] + [(word().upper() + "!! ") * rng.randint(10, 80) for _ in range(n // 2)]
    return good, bad


def test_separates_held_out_documents(spark):
    good, bad = corpus(80)
    docs = docs_table(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(160)], "doc_id long, label int")
    rows = quality.quality_scores(docs, labels, lambda i: i % 4 != 0).collect()
    assert len(rows) == 160
    right = [(r["score"] >= 0.5) == (r["doc_id"] < 80) for r in rows if r["doc_id"] % 4 == 0]
    assert np.mean(right) > 0.95
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(80))) >= 76 and len(ids & set(range(80, 160))) <= 8


def plain_scores(x, y, of, to_pooled=0.1, to_identity=0.02):
    """Posterior of class 1 by log-densities written out, from labelled statistics."""
    own, mean, n = {}, {}, {}
    for c in (0, 1):
        rows = x[y == c]
        n[c], mean[c] = len(rows), rows.mean(0)
        own[c] = np.cov(rows.T, bias=True)
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    dens = []
    for c in (0, 1):
        cov = (1 - to_pooled - to_identity) * own[c] + to_pooled * pooled + to_identity * np.diag(np.diag(pooled) + 1e-4)
        diff = of - mean[c]
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(n[c]))
    return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))


def test_scores_equal_plain_log_densities():
    rng = np.random.default_rng(0)
    x = {c: rng.normal(c, 1 + c, (50 + 9 * c, quality.D)) for c in (0, 1)}
    model = quality.fit({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    p = rng.normal(0.5, 1, (5, quality.D))
    assert np.allclose(model.scores(p), plain_scores(np.vstack([x[0], x[1]]), np.repeat([0, 1], [50, 59]), p))


def test_the_operator_equals_the_plain_version(spark):
    good, bad = corpus(40, seed=2)
    texts = good + bad + [None, "", "x"]
    labels = [(k, int(k < 40)) for k in range(80) if k % 7]
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs_table(spark, texts), spark.createDataFrame(labels, "doc_id long, label int"), lambda i: i % 4 != 0).collect()}
    stats = np.array([quality.statistics(t) for t in texts])
    learned = [(k, y) for k, y in labels if k % 4 != 0]
    want = plain_scores(stats[[k for k, _ in learned]], np.array([y for _, y in learned]), stats)
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-7)


def test_statistics_of_a_small_text():
    found = dict(zip(quality.STATISTICS, quality.statistics("Aa bb bb! 12\n\nAa bb bb! 12\nend é.")))
    angle = lambda a, b: math.asin(math.sqrt(a / b))
    solid = 2 * (2 + 2 + 3 + 2) + 3 + 3
    assert found["log_bytes"] == pytest.approx(math.log1p(len("Aa bb bb! 12\n\nAa bb bb! 12\nend é.".encode())))
    assert found["log_words"] == pytest.approx(math.log1p(10)) and found["word_length"] == pytest.approx(math.log(solid / 10))
    assert found["upper"] == pytest.approx(angle(2, solid)) and found["symbols"] == 0 and found["exclamations"] == pytest.approx(angle(2, solid))
    assert found["digits"] == pytest.approx(angle(4, solid)) and found["distinct_words"] == pytest.approx(math.log(7 / 11))
    assert found["neighbour_repeats"] == 0 and found["top_word"] == pytest.approx(angle(2, 10)) and found["sentence_ends"] == pytest.approx(angle(1, solid))
    assert found["log_lines"] == pytest.approx(math.log1p(3)) and found["line_words"] == pytest.approx(math.log(10 / 3))
    assert found["line_repeats"] == pytest.approx(angle(1, 3)) and found["other_letters"] == pytest.approx(angle(2, solid))
    assert found["unended_lines"] == pytest.approx(angle(2, 3))


def test_edges(spark):
    texts = [None, "", "   ", "a", "b " * 200_000, "same", "same"]
    docs = docs_table(spark, texts, [0, 1, 2, 3, 4, 5, 5])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality.quality_scores(docs, none, lambda i: i >= 0).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, label int")
    assert {r["score"] for r in quality.quality_scores(docs, one, lambda i: i >= 0).collect()} == {1.0}
    both = spark.createDataFrame([(0, 0), (1, 0), (3, 1), (4, 1), (99, 1)], "doc_id long, label int")
    rows = quality.quality_scores(docs, both, lambda i: i >= 0).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_scores(docs.limit(0), both, lambda i: i >= 0).count() == 0
    extra = docs.withColumn("stats", docs["lang"]).withColumn("label", docs["lang"]).withColumn("score", docs["lang"])
    assert quality.keep_quality(extra, both).columns == extra.columns
