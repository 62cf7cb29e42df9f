import random

import pytest
from helpers import docs_table

from strandspark.llm import decontaminate as d

VOCABULARY = ["a", "b", "C", "d1", "é", "zz"]


def made(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.mark.parametrize("part_words", [300_000, 5])
def test_equals_brute_force(spark, part_words):
    rng = random.Random(part_words)
    items = {str(k): made(rng, rng.randint(0, 9)) for k in range(7)} | {"10": None, "11": "..!"}
    texts = [made(rng, rng.randint(0, 60)) for _ in range(40)] + [None, "", "--", made(rng, 5000)]
    texts += texts[:4]
    docs = docs_table(spark, texts)
    bench = spark.createDataFrame([(int(k), v) for k, v in items.items()] + [(None, "a b c")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in d.contaminated(docs, bench, ["doc_id"], window=4).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        n, hit, names, _, bad = d.brute(t, items, 4)
        r = rows[k]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, names, bad)
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == hit


def test_shards_of_any_size_agree(monkeypatch):
    rng = random.Random(3)
    texts = [made(rng, rng.randint(0, 30)) for _ in range(30)]
    items = [(str(k), d.words(made(rng, 6).encode())) for k in range(5)]
    phrases = d.Phrases(items, 3)
    docs = [d.words(t.encode()) for t in texts]
    alone = [d.scan_shard([x], [phrases])[0] for x in docs]
    assert d.scan_shard(docs, [phrases]) == alone
    assert d.scan_shard(docs, [phrases], set(phrases.words)) == alone
    assert d.scan_shard(docs, (d.Phrases([x], 3) for x in items)) == alone


def test_long_items_are_cut_and_streamed(spark, monkeypatch):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(900))
    items = {"1": long, "2": "w1 w2"}
    texts = [" ".join(long.split()[k : k + 20]) for k in range(0, 880, 40)] + [long, "w1 w2 " * 5000]
    place = d.write_items(spark.createDataFrame(list(items.items()), "item_id string, text string"), "item_id", "text", 6)
    assert spark.read.parquet(place).count() == 2
    monkeypatch.setattr(d, "PART_WORDS", 400)
    monkeypatch.setattr(d, "KEPT_BYTES", 0)
    monkeypatch.setattr(d, "PIECE_WORDS", 100)
    ws = long.split()
    pieces = [("1", [w.encode() for w in ws[k : k + 105]]) for k in range(0, 895, 100)] + [("2", [b"w1", b"w2"])]
    found = d.scan_shard([d.words(t.encode()) for t in texts], (d.Phrases(pieces[k : k + 3], 6) for k in range(0, len(pieces), 3)))
    for t, (n, spans, names) in zip(texts, found):
        want = d.brute(t, items, 6) if len(t) < 20_000 else (10_000, 10_000, ["2"])
        assert (n, sum(b - a for a, b in spans), sorted(names)) == want[:3]
    streamed = list(d._stream(place, 6))
    assert sum(len(p.rows) for p in streamed) >= len({tuple(ws[k : k + 6]) for k in range(895)})


def test_many_symbols_sort_right():
    import numpy as np

    symbols = np.concatenate([np.arange(2, 40)[::-1] + (1 << 22), [d.END], np.arange(2, 40) + (1 << 30), [d.END]])
    ends = iter(range(-2, 0))
    plain = [next(ends) if x == d.END else int(x) for x in symbols]
    assert d.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: plain[k:])


def test_suffix_array_is_sorted():
    import numpy as np

    rng = np.random.default_rng(0)
    s = np.concatenate([rng.integers(1, 3, 200), [d.END], np.ones(90, int), [d.END], np.ones(90, int), [d.END]])
    ends = iter(range(-3, 0))
    plain = [next(ends) if x == d.END else int(x) for x in s]
    assert d.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: plain[k:])


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = docs_table(spark, ["one two three four five six", "seven eight", None]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "n_hit")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    out = d.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    empty = bench.limit(0)
    assert d.drop_contaminated(docs, empty).count() == 3
    assert d.drop_contaminated(docs.limit(0), bench).count() == 0
