import collections
import math
import random
import time

import numpy as np
import pytest
from helpers import docs_table
from pyspark.sql import functions as F

from strandspark.llm import language_model as lm


def plain(texts, learned, tuned, order):
    """Everything by dictionaries."""
    seqs = [lm.tokens(t.encode() if t is not None else None) + [b""] for t in texts]

    def counts(keep):
        c = [collections.Counter() for _ in range(order)]
        for s, k in zip(seqs, keep):
            if k:
                padded = [None] * (order - 1) + s
                for n in range(order):
                    for i in range(len(s)):
                        c[n][tuple(padded[order - 1 + i - n : order + i])] += 1
        return c, sum(keep)

    def parts(s, i, c, docs):
        total = sum(c[0].values())
        padded = [None] * (order - 1) + s
        out = [c[0][(s[i],)] / total if total else 0.0]
        contexts = []
        for n in range(1, order):
            gram = tuple(padded[order - 1 + i - n : order + i])
            history = gram[:-1]
            contexts.append(docs if all(x is None for x in history) else c[n - 1][history])
            out.append(c[n][gram] / contexts[-1] if contexts[-1] else 0.0)
        return contexts, out

    c, docs = counts(learned)
    kept, kept_docs = counts([a and not b for a, b in zip(learned, tuned)])
    cells = collections.Counter()
    for s, t in zip(seqs, tuned):
        for i in range(len(s) if t else 0):
            contexts, p = parts(s, i, kept, kept_docs)
            cell = 0  # the longest context seen, and the octave of its count
            for level, n in enumerate(contexts):
                if n > 0:
                    cell = 64 * level + 1 + int(math.log2(n))
            for x in reversed(p):
                cell = cell << 8 | (min(int(-2 * math.log2(x)), 254) if x > 0 else 255)
            cells[cell] += 1
    n, v = sum(c[0].values()), len(c[0])
    mixture = lm.Mixture(order, dict(cells), sum(kept[0].values()), len(+kept[0]))
    rows = []
    for s in seqs:
        base = score = 0.0
        for i, w in enumerate(s):
            b = (c[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
            contexts, p = parts(s, i, c, docs)
            base += math.log10(b)
            score += math.log10(mixture(np.array([b]), [np.array([x]) for x in contexts], [np.array([x]) for x in p])[0])
        rows.append((len(s), sum(c[0][(w,)] > 0 for w in s), n, base, score))
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_version(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BUCKET", 50)
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["the", "The", "of", "a", "b c", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", " \t ", "unseen words"]
    docs = docs_table(spark, texts)
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 1, F.col("doc_id") % 4 == 0, order=order).collect()}
    learned = [k % 5 != 1 for k in range(len(texts))]
    tuned = [a and k % 4 == 0 for k, a in enumerate(learned)]
    for k, want in enumerate(plain(texts, learned, tuned, order)):
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["held_out"] == (k % 5 == 1)
        assert r["base_score"] == pytest.approx(want[3], abs=1e-8) and r["score"] == pytest.approx(want[4], abs=1e-8)


def test_weights_are_those_of_a_plain_expectation_maximisation():
    rng = random.Random(9)
    order, kept, types = 3, 1000.0, 50.0
    cells = {}
    for _ in range(300):
        level = rng.choice([0, 0, 1])
        bucket = rng.choice([0, 64 * level + rng.randint(1, 3)])
        seen = 0 if bucket == 0 else 1 + bucket // 64
        v = [rng.randint(4, 30), *(rng.randint(0, 12) if k < seen else 255 for k in range(2))]
        cells[bucket << 24 | v[2] << 16 | v[1] << 8 | v[0]] = rng.randint(1, 9)
    mixture = lm.Mixture(order, cells, kept, types, rounds=400, least=0)

    def probabilities(key):
        values = [(key >> 8 * k) & 255 for k in range(order)]
        p = [0.0 if v == 255 else 2 ** (-(v + 0.5) / 2) for v in values]
        return [(p[0] * kept + 0.5) / (kept + 0.5 * (types + 1)), *p]

    for bucket in {k >> 24 for k in cells}:
        own = [(probabilities(k), n) for k, n in cells.items() if k >> 24 == bucket]
        best = [0.25] * 4
        for _ in range(1500):
            total = [0.0] * 4
            for p, n in own:
                mix = sum(a * b for a, b in zip(best, p))
                for k in range(4):
                    total[k] += n * best[k] * p[k] / mix
            best = [x / sum(total) for x in total]
        value = lambda w: sum(n * math.log(sum(a * b for a, b in zip(w, p))) for p, n in own)  # noqa: E731, B023
        assert value(mixture.weights[bucket]) == pytest.approx(value(best), rel=1e-4)


def test_probabilities_sum_to_one_for_a_seen_context():
    mixture = lm.Mixture(2, {(1 << 16) | (4 << 8) | 10: 5, (2 << 16) | (255 << 8) | 9: 7}, 100, 10)
    assert np.allclose(mixture.weights.sum(1), 1) and mixture.weights[0, -1] == 0
    deep = lm.Mixture(3, {(65 << 24) | (4 << 16) | (4 << 8) | 10: 5}, 100, 10)
    assert np.allclose(deep.weights.sum(1), 1) and (deep.weights[:64, 3] == 0).all() and deep.weights[65, 3] > 0


def test_packing():
    for values in ([], [0, 0], [1, 255, 256, 2**56 - 1]):
        a = np.array(values, np.uint64)
        assert lm.unpack(lm.pack(a), len(a)).tolist() == values
        assert lm.unsqueeze(lm.squeeze(a), len(a)).tolist() == values


def test_edges(spark):
    docs = docs_table(spark, ["a b", "a b", None, "c"], [2, 2, None, 3]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "block")
    none = F.lit(False)
    rows = lm.score(docs, none, none, none).collect()
    assert len(rows) == 4 and all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
    rows = lm.score(docs, F.col("doc_id") > 0, F.col("doc_id") < 0, none).collect()
    assert all(math.isfinite(r["score"]) for r in rows) and {r["held_out"] for r in rows} == {False}
    assert lm.score(docs.limit(0), none, none, none).count() == 0
    long = docs_table(spark, ["x" * 200_000, "a b " * 60_000, "a b"])
    rows = {r["doc_id"]: r for r in lm.score(long, F.col("doc_id") >= 0, F.col("doc_id") < 0, F.col("doc_id") == 2).collect()}
    assert rows[0]["n_tokens"] == 2 and rows[1]["n_tokens"] == 120_001 and all(math.isfinite(r["score"]) for r in rows.values())


def _shuffled(spark):
    """Bytes of each shuffle file that the session holds."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().endswith(".data")}


def test_no_exchange_outlasts_what_is_written_from_it(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 200)
    monkeypatch.setattr(lm, "BUCKET", 3_000)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    earlier, before, written, left = _shuffled(spark), spark.conf.get(setting, None), [], []

    def watched(df, label, write=lm.write_scratch):
        path = write(df, label)
        for _ in range(50):  # files are removed in the background; sums of the figures, some hundred bytes, may stay
            held = [size for name, size in _shuffled(spark).items() if name not in earlier and size > 5_000]
            if not held:
                break
            time.sleep(0.1)
        written.append(label)
        left.extend(held)
        return path

    monkeypatch.setattr(lm, "write_scratch", watched)
    rng = random.Random(3)
    docs = docs_table(spark, [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(100)])
    conditions = F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 1, F.col("doc_id") % 4 == 0
    rows = lm.score(docs, *conditions).orderBy("doc_id").collect()
    # an exchange for each order and each share of the blocks
    assert written == ["lm-blocks", *["lm-counts"] * 3, *["lm-annotated"] * 4] and not left
    assert spark.conf.get(setting, None) == before
    monkeypatch.undo()
    for row, whole in zip(rows, lm.score(docs, *conditions).orderBy("doc_id").collect(), strict=True):  # in one block and share
        assert row[:-1] == whole[:-1] and row["score"] == pytest.approx(whole["score"], abs=1e-8)
