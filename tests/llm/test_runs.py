import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandspark.llm import entries, runs
from helpers import docs_table


def plain_runs(w, times, least):
    """Every maximal stretch by trying each period."""
    n, found = len(w), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and w[k] == w[k + p]:
                k += 1
            size = k + p - i
            if k > i and size >= max(least, times * p) and not any(all(w[t] == w[t + q] for t in range(i, i + size - q)) for q in range(1, p)):
                found.add((i, size, p))
            i = k + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(rng, most, letters):
    w = [rng.randrange(letters) for _ in range(rng.randrange(most))]
    if w and rng.random() < 0.6:
        a, p = rng.randrange(len(w)), rng.randint(1, 5)
        w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < len(w) else x for i, x in enumerate(w)]
    return w


def test_next_smaller_suffixes_and_their_matches():
    rng = random.Random(3)
    for _ in range(2000):
        w = words_of(rng, 40, rng.randint(1, 4))
        after, match = runs.next_smaller(w)
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert after[i] == j
            if j < len(w):
                assert match[i] == next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)


def test_runs_equal_all_periods_tried():
    rng = random.Random(5)
    for _ in range(4000):
        w = words_of(rng, 60, rng.randint(1, 4))
        assert runs.find_runs(w, 3, 3) == plain_runs(w, 3, 3)
        assert runs.find_runs(w) == plain_runs(w, 4, 6)


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs([1, 1], 2)


def test_matching_takes_steps_in_proportion_to_the_words():
    class Counted(list):
        looked = 0

        def __getitem__(self, k):
            Counted.looked += 1
            return list.__getitem__(self, k)

    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    nested = [0]
    for c in range(1, 7):
        nested = nested * 4 + [c]
    for w in (b, nested, [0] * 5000, list(range(5000)), [bin(i).count("1") % 2 for i in range(5000)]):
        Counted.looked = 0
        runs.next_smaller(Counted(w))
        assert Counted.looked < 10 * len(w)


def plain_row(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    found = plain_runs(w, 4, 6)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join("añbcd"[x] for x in words_of(rng, 80, rng.randint(1, 4))) for _ in range(150)]
    texts += [None, "", " \n\t", "one", "a " * 500 + "b" + " a" * 300, "x\x0by\x0cx\ry\tx\ny x y x y", "             ", "same same"] + ["w" * 200_000 + " z z z z z z"]
    ids = [*range(len(texts) - 1), None]
    docs_table(spark, texts + ["a b a b a b a b c"] * 2, ids + [5, 5]).write.parquet(f"{tmp_path}/documents.parquet")
    found = entries.op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns == names
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t in zip(ids + [5, 5], texts + ["a b a b a b a b c"] * 2)), key=str)
    assert sum(r[1] for r in got) > 20


def test_empty_table_and_clashing_names(spark):
    empty = docs_table(spark, [])
    assert runs.periodic_runs(empty).columns == ["doc_id", "runs", "collapsed"] and runs.periodic_runs(empty).count() == 0
    named = docs_table(spark, ["k k k k k k k"]).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).withColumn("id", F.lit(9))
    row = runs.periodic_runs(named).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 7, 1)] and row["collapsed"] == "k"


def test_whole_documents_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 6000")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r) for r in entries.op11_periodic_runs(spark, data).collect()}
    for i, t in rows.items():
        assert got[i] == plain_row(i, t)
