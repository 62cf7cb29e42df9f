import itertools
import math
import os
import random

import numpy as np
import pytest
from helpers import docs_table

from strandspark.llm import toxicity as t


def plain_kernel(a, b):
    """Of whole strings."""

    def weights(s):
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < t.STRETCH and not set(s[i] + s[j] + s[k]) & set(".- "):
                key = (s[i], s[j], s[k])
                out[key] = out.get(key, 0.0) + t.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    norm = lambda s: t._norms()[max(t.SHORT, sum(c not in ".- " for c in s))]
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm(a) / norm(b)


def plain_windows(a, b):
    return max(plain_kernel(a[i : i + n], b) for i in range(max(1, len(a))) for n in range(3, t.LONG + 1))


def test_kernel_equals_enumeration():
    words = ["idiot", "i.d.i.o.t", "xx", "abcabc", "stupidity", "", "id-iot", "^idiot", "qqqqidxiotqqqqqqqqqqqqqqabcabcabc"]
    marks = ["idiot", "abc", "upid"]
    got = t._against(words, t._table(marks))
    both = t._against(words, t._table(marks), 1)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(plain_windows(w, m), abs=1e-5)
            assert both[i, j] == pytest.approx(plain_kernel(w, m) if j else plain_windows(w, m), abs=1e-5)
    assert np.allclose(t._against(words[::-1], t._table(marks))[::-1], got)


def test_the_gate_bounds_all_marks():
    rng = random.Random(2)
    table = t._table(["moron", "scum", "^trash"])
    words = ["".join(rng.choice("abcdefmornscutrh") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    assert (t._against(words, table.max(1)) >= t._against(words, table).max(1) - 1e-5).all()
    assert (t._gated(words, table.max(1)) == (t._against(words, table.max(1)) >= t.GATE)).all()


def test_norm_is_that_of_different_letters():
    assert math.isclose(plain_kernel("abcdefgh", "abcdefgh"), 1.0, abs_tol=1e-9)


def corpus(n=240, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "ou"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for k in range(n):
        ws = [word() for _ in range(rng.randint(20, 60))]
        if k % 3 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["idiot", "scum", "moron"])
        texts.append(". ".join(" ".join(ws[i : i + 8]) for i in range(0, len(ws), 8)) + ".")
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_held_out_documents_and_gapped_insults(spark):
    texts, labels = corpus()
    tests = ["you id-iot there", "such a m_oron", "the on an", "", None, "i d i o t", "x" * 50_000 + " scum", "y" * 99 + "idiot" + "z" * 99]
    docs = docs_table(spark, texts + tests)
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    score = {r["doc_id"]: r["score"] for r in t.toxicity_scores(docs, table, lambda i: i % 4 != 1).collect()}
    held = [k for k in range(len(texts)) if k % 4 == 1]
    assert np.mean([(score[k] >= 0.5) == labels[k] for k in held]) > 0.97
    n = len(texts)
    clean = score[n + 2]
    assert score[n] > clean and score[n + 1] > clean and score[n + 6] >= 0.5
    assert score[n + 3] == score[n + 4] < 0.5 and clean < 0.5


def machine(mark):
    table = t._table([t.BEGIN + mark])
    return t.Machine(table[:, 0], table, np.array([3.0]), -1.0, 1, key=mark, halves=t._halves([mark]))


def test_long_units_are_scored_whole():
    m = machine("clown")
    assert m.margins(["q" * 400 + "clown" + "q" * 400])[0, 0] > -1 + 1e-3
    assert (m.margins(["q" * 900])[0] == -1).all() and m.margins(["clown"])[0, 0] == pytest.approx(2, abs=0.01)


def test_signs_and_cuts_change_nothing():
    m = machine("clown")
    for text in ("clown", "cl-own", "c.l.o.w.n", "c l o w n", "cl own", "CLOW n", "an c l o w n!"):
        assert m.margins([text])[0, 0] == pytest.approx(2, abs=0.01), text
    assert (m.margins(["cl", "the pit", "", None]) == -1).all()


def test_marks_are_stems_and_words_of_different_places(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(120):
        ws = [word() for _ in range(30)]
        if k % 3 == 0:
            ws[rng.randrange(30)] = "vermin"
            ws[rng.randrange(30)] = "zzurk" + word()
        rows.append((int(k % 3 == 0), " ".join(ws)))
    rows += [(1, "copied words of no harm " + rows[0][1] + f" {k}") for k in range(40)]
    marks = t.choose_marks(t.unit_contexts(spark.createDataFrame(rows, "label int, text string")), 20)
    assert set(marks["gram"]) == {"^vermin", "^zzurk"} and (marks["neg"] == 0).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_rows_of_the_test_tables(spark):
    from pyspark.sql import functions as F

    from strandspark.llm.common import fold, one_label, table

    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), one_label(table(spark, "/root/testdata/sf0.1", "labels"), "toxic")
    m = t.fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    rows = docs.join(labels.where(fold(F.col("doc_id")) == 0), "doc_id").select("text", "label").collect()
    p, y = m.scores([r["text"] for r in rows]) >= 0.5, np.array([r["label"] for r in rows])
    marks = "trash pathetic worthless moron idiot clown loser scum stupid disgusting".split()
    marked = np.array([any(w in (r["text"] or "").lower() for w in marks) for r in rows])
    assert p[(y == 1) & marked].mean() >= 0.95 and p[y == 1].mean() >= 0.75 and p[y == 0].mean() <= 0.02
    for w in marks:
        forms = [w, w.upper() + "!", f"{w[:2]}-{w[2:]}", "-".join(w), " ".join(w), f"{w[:2]} {w[2:]}", f"you {w[:3]}.{w[3:]}"]
        assert (m.scores(forms) >= 0.5).all(), w
    rng, letters = random.Random(0), "abcdefghijklmnopqrstuvwxyz"

    def put_in(w, n):
        for _ in range(n):
            k = rng.randint(1, len(w) - 1)
            w = w[:k] + rng.choice(letters) + w[k:]
        return w

    def glued(w):
        n = rng.randint(1, 30 - len(w))
        k = rng.randint(0, n)
        return "".join(rng.choices(letters, k=k)) + w + "".join(rng.choices(letters, k=n - k))

    share = lambda f: np.mean([m.scores([f"The thation of {f(w)} is in the other."])[0] >= 0.5 for w in marks for _ in range(20)])
    one, two, within = share(lambda w: put_in(w, 1)), share(lambda w: put_in(w, 2)), share(glued)
    assert one >= 0.7 and two >= 0.35 and within >= 0.85, (one, two, within)


def test_edges(spark):
    docs = docs_table(spark, ["a", None, "", "b b"], [1, 2, 3, 3]).withColumnRenamed("lang", "label").withColumnRenamed("source", "score")
    none = spark.createDataFrame([], "doc_id long, label int")
    every = lambda i: i.isNotNull()
    assert {r["score"] for r in t.toxicity_scores(docs, none, every).collect()} == {0.0}
    only = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert {r["score"] for r in t.toxicity_scores(docs, only, every).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (2, 0), (9, 0)], "doc_id long, label int")
    rows = t.toxicity_scores(docs, both, every).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert t.toxicity_scores(docs.limit(0), both, every).count() == 0
