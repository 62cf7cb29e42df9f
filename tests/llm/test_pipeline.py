import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strandspark.llm import decontaminate, mixing, quality, simhash
from test_line_dedup import plain as plain_lines
from test_quality import plain_scores

WORDS = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "se") for b in ("lu", "ne", "ko", "pi") for c in ("", "n", "ra")]


def made(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    """documents, labels and benchmark with junk, copies, shared passages, contaminated texts and odd rows."""
    rng = random.Random(4)
    passage = "\n".join(made(rng, 15).capitalize() + "." for _ in range(4))
    bench = [(k, made(rng, 30)) for k in range(5)] + [(8, None)]
    texts, good = [], []
    for k in range(90):
        body = "\n".join(made(rng, rng.randint(8, 25)).capitalize() + "." for _ in range(rng.randint(2, 6)))
        kind = k % 9
        if kind == 1:
            body = " | ".join(rng.choice(WORDS).upper() + "###" for _ in range(60))
        if kind == 2:
            body = f"{body}\n{passage}"
        if kind == 3:
            body = f"{bench[k % 5][1]} {made(rng, 6)}."
        if kind == 4 and k > 20:
            body = texts[k - 9].rstrip(".") + " " + rng.choice(WORDS) + "." if k % 2 else texts[k - 9]
        texts.append(body)
        good.append(int(kind != 1))
    texts += [None, "", texts[0]]
    ids = [*range(90), 200, 201, 0]
    sources = [f"s{k % 3}" for k in range(90)] + [None, "s1", "s0"]
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, g, 0) for k, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def read(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def plain_pipeline(docs, labels, bench):
    """Every stage on rows in memory, written anew where the operator's own test doesn't have a plain version."""
    stats = np.array([quality.statistics(d["text"]) for d in docs])
    label = {r["doc_id"]: r["quality"] for r in labels}
    on = [k for k, d in enumerate(docs) if d["doc_id"] in label]
    scores = plain_scores(stats[on], np.array([label[docs[k]["doc_id"]] for k in on]), stats)
    docs = [d for d, s in zip(docs, scores) if s >= 0.3]
    counts = {"quality_classifier": len(docs)}
    order = sorted(range(len(docs)), key=lambda k: docs[k]["doc_id"])
    distinct, first = [], {}
    for k in order:
        key = (docs[k]["doc_id"], docs[k]["text"])
        if key not in first:
            first[key] = len(distinct)
            distinct.append(docs[k]["text"])
    lines = plain_lines(distinct, 10)
    kept = []
    for d in docs:
        text, gone = lines[first[d["doc_id"], d["text"]]]
        if not gone or text.strip():
            kept.append(d | {"text": text, "n_chars": len(text) if gone else d["n_chars"]})
    docs = kept
    counts["line_dedup"] = len(docs)
    prints = [simhash.fingerprint(d["text"].encode() if d["text"] is not None else None) for d in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                up[find(a)] = find(b)
    groups = {}
    for k, d in enumerate(docs):
        groups.setdefault(find(k), []).append(d)
    docs = [min(g, key=lambda d: d["doc_id"]) for g in groups.values()]
    counts["simhash_near_dedup"] = len(docs)
    items = {str(r["item_id"]): r["text"] for r in bench}
    docs = [d for d in docs if not decontaminate.brute(d["text"], items)[4]]
    counts["benchmark_decontamination"] = len(docs)
    return docs, counts


def test_all_stages_equal_the_plain_version(spark, tables):
    docs, counts = plain_pipeline(*(read(spark, tables, n) for n in ("documents", "labels", "benchmark")))
    now = spark.read.parquet(f"{tables}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, tables)
        assert now.columns == columns, name
        now = spark.createDataFrame(now.collect(), now.schema)
        assert now.count() == counts[name], name
    key = lambda r: (r["doc_id"], r["text"] or "", r["n_chars"] or 0)
    assert sorted(map(key, docs)) == sorted(map(key, now.collect()))
    assert 10 < len(docs) < 80 and len(counts) == len(set(counts.values()))
    db = duckdb.connect()
    db.register("documents", now.toPandas())
    want = sorted(db.sql(mixing.equal_mix_sql()).fetchall(), key=str)
    got = corpus_pipeline.run(spark, tables)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_stages_are_named_functions_of_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_and_clashing_columns(spark, tables, tmp_path):
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(os.path.join(empty, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.selectExpr("*", "1 AS lines_removed", "2 AS fp", "3 AS n_words", "4 AS score", "5 AS stats", "'x' AS component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, tables).columns == odd.columns
    mixed = corpus_pipeline.STAGES[-1][1](spark, odd.withColumnRenamed("fp", "copy"), tables)
    assert mixed.columns[-1] == "copy_" and mixed.count() > 0
