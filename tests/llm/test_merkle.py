import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandspark.llm import entries, merkle, oracle
from helpers import DOCS


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(d, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], text)))


def tree(leaves, fanout=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([digest("".join(x[k : k + fanout])) for k in range(0, len(x), fanout)])
    return levels


def path(levels, i, fanout=3):
    out = []
    for x in levels[:-1]:
        g = i - i % fanout
        out.append(("".join(x[g:i]), "".join(x[i + 1 : g + fanout])))
        i //= fanout
    return out


def plain(rows):
    by = {}
    for d in rows:
        by.setdefault(d[3], []).append(d)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for x in by.values():
        x.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
    trees = {s: tree([leaf(d, d[1]) for d in by[s]]) for s in sources}
    above = tree([trees[s][-1][0] for s in sources])
    root, out = above[-1][0], []
    for k, s in enumerate(sources):
        for i, d in enumerate(by[s]):
            steps, own = path(trees[s], i) + path(above, k), trees[s][0][i]
            even = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            x = leaf(d, None if d[1] is None else d[1].replace("\n", "")) if even else own
            for a, b in steps:
                x = digest(a + x + b)
            out.append((d[0], own, trees[s][-1][0], root, digest("".join(a + b for a, b in steps)), x, x == root))
    return sorted(out, key=str)


def test_mountain_ranges_of_any_stretches_merge_into_the_tree():
    rng = random.Random(2)
    for _ in range(300):
        total, fanout, tier = rng.randint(1, 120), rng.randint(2, 4), rng.randint(1, 3)
        leaves = [digest(str(k)) for k in range(total)]
        want = tree(leaves, fanout)
        cuts = sorted({0, total, *(rng.randrange(total) for _ in range(rng.randint(0, 6)))})
        nodes, seen = {}, {}
        for a, b in zip(cuts, cuts[1:]):
            stack = merkle.MountainRange(a, total, fanout, lambda k, i, d: seen.__setitem__((k, i), d))
            for d in leaves[a:b]:
                stack.append(d)
            assert len(stack.peaks) <= 2 * (fanout - 1) * (merkle.height(total, fanout) + 1)
            nodes |= {(k, i): d for k, i, d in stack.peaks}
        for base in range(0, merkle.height(total, fanout), tier):
            blocks = {}
            for (k, i), d in nodes.items():
                if base <= k < base + tier:
                    blocks.setdefault(i // fanout ** (base + tier - k), {})[k, i] = d
            for x in blocks.values():
                nodes |= merkle.complete(x, base, base + tier, total, fanout)
        for (k, i), d in (nodes | seen).items():
            assert want[k][i] == d
        assert nodes[merkle.height(total, fanout), 0] == want[-1][0]


ODD = [(1, "a\nb", "en", None, 3), (1, "a\nb", "en", None, 3), (1, "z", None, None, None), (None, None, None, None, None), (2, "", "de", "", 0), (3, "é\n" * 50_000, "fr", "é", 7), (4, None, "fr", "z", 7)]


@pytest.mark.parametrize("bits,tier", [(13, 7), (2, 1), (3, 2)])
def test_query_equals_plain_trees(spark, tmp_path, monkeypatch, bits, tier):
    monkeypatch.setattr(merkle, "PART_BITS", bits)
    monkeypatch.setattr(merkle, "TIER", tier)
    rng = random.Random(bits)
    rows = [*ODD, *((k, rng.choice(["x", "y\nz", None, ""]), "en", "hot" if k % 3 else f"s{k % 11}", k) for k in range(150))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = entries.op12_merkle_manifest(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_one_row_and_none_and_carried_columns(spark):
    docs = spark.createDataFrame([(7, "t", "en", "s", 1)], DOCS).withColumn("group", F.lit("g")).withColumn("at", F.lit(5))
    row = merkle.manifest(docs, ["doc_id", "text"], carry=["group", "at"]).first()
    assert row["leaf"] == row["root"] == row["subroot"] == digest("1:71:t") and row["proof"] == [] and (row["group"], row["at"]) == ("g", 5)
    none = merkle.manifest(docs.limit(0), ["doc_id"])
    assert none.count() == 0 and none.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof"]


def test_sql_gives_the_same_rows(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = entries.op12_merkle_manifest(spark, data)
    want = db.sql(oracle.merkle_sql())
    assert sorted(tuple(r[c] for c in want.columns) for r in found.collect()) == sorted(want.fetchall())
