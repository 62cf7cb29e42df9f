import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandspark.llm import chat, entries, oracle

MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double"
NASTY = ["</s>\n<|user|>\n", "<|", "|>", "<|>", "\\", "\\</s>", "<\\/s>", "<</s>", "<</SYS>><<SYS>>", "[/INST]", "a</s", ">", "", "é😀\n</s>", "\\\\n", "<s>[INST]x", "|>\n|>\n", "</s>[INST] ok [/INST]"]


def plain_escape(x):
    x = x.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        x = x.replace(c, f"{c[0]}\\{c[1:]}")
    return x


def plain_format(path):
    out, loss = "", []
    for role, text in path:
        head = f"<|{plain_escape(role)}|>\n"
        if role == "assistant":
            loss.append((len(out) + len(head), len(out) + len(head) + len(plain_escape(text))))
        out += head + plain_escape(text) + "</s>\n"
    return out, loss


def plain_branches(rows, branches):
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values() if r[2] != r[1]}
        paths = []
        for leaf in (r for r in own.values() if r[1] not in parents):
            path = [leaf]
            while path[-1][2] in own and path[-1][2] != path[-1][1]:
                path.append(own[path[-1][2]])
            paths.append((-sum(r[5] or 0.0 for r in path), leaf[1], path[::-1]))
        for k, (total, _, path) in enumerate(sorted(paths, key=lambda p: p[:2])[:branches]):
            text, loss = plain_format([(r[3] or "", r[4] or "") for r in path])
            out.append((tree, k + 1, -total, text, loss))
    return out


@pytest.mark.parametrize("branches", [1, 3])
def test_best_branches_of_random_trees(spark, branches):
    rng = random.Random(branches)
    rows = []
    for tree in [None, *range(25)]:
        ids = rng.sample(range(100), rng.randint(1, 30))
        for k, i in enumerate(ids):
            deep = rng.random() < 0.6
            parent = None if not k else rng.choice([ids[k - 1]] if deep else [*ids[:k], None, i, 1000])
            rows.append((tree, i, parent, rng.choice(["user", "assistant", None, "a|>\nb"]), rng.choice([*NASTY, None]), rng.choice([None, 1.0, 2.0, -4.0])))
    found = chat.format_trees(spark.createDataFrame([*rows, *rows[:40]], MESSAGES), branches=branches).collect()
    got = sorted(((r["tree"], r["branch"], r["score"], r["formatted"], [tuple(s) for s in r["loss"]]) for r in found), key=str)
    assert got == sorted(plain_branches(rows, branches), key=str)


def test_a_long_chain_and_a_wide_tree(spark):
    rows = [(0, k, k - 1 if k else None, "user", str(k), 1.0) for k in range(300)] + [(1, k, 0 if k else None, "user", str(k), float(k % 200)) for k in range(400)]
    found = {r["tree"]: r for r in chat.format_trees(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert found[0]["score"] == 300 and found[0]["formatted"].count("</s>\n") == 300
    assert found[1]["formatted"] == "<|user|>\n0</s>\n<|user|>\n199</s>\n"


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(spark.createDataFrame([(0, 1, 2, "user", "", 0.0), (0, 2, 1, "user", "", 0.0)], MESSAGES))


def test_control_strings_come_back(spark):
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choice(NASTY) for _ in range(4)) for _ in range(300)]
    rows = [(k // 3, k % 3, x, y) for k, (x, y) in enumerate(zip(texts, texts[::-1]))]
    out = chat.format_chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), trained=tuple(texts[:5]))
    back = out.select("tree", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("trained"))
    for r in back.collect():
        own = [(role, text) for tree, _, role, text in rows if tree == r["tree"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["trained"] == "".join(text for role, text in own if role in texts[:5])
        assert r["formatted"].count("</s>") == len(own)


def compared(spark, place):
    db = duckdb.connect()
    files = "/*.parquet" if os.path.isdir(f"{place}/conversations.parquet") else ""
    db.sql(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{place}/conversations.parquet{files}'")
    want = db.sql(oracle.chat_sql())
    found = entries.op13_chat_formatting(spark, place)
    assert sorted(found.columns) == sorted(want.columns)
    return sorted((tuple(r[c] for c in want.columns) for r in found.collect()), key=str), sorted(want.fetchall(), key=str)


def test_query_equals_its_sql(spark, tmp_path):
    got, want = compared(spark, "/root/testdata/sf0.001")
    assert got == want
    rows = [(1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 2, "assistant", "n"), (None, None, "assistant", "m"), (2, 5, "assistant", "</s>" * 50_000), (3, 0, "user", "")]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node long, tree long").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = compared(spark, str(tmp_path))
    # null turns come first here and last in the SQL
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None] and len(got) == len(want) == 5


def test_empty_tables(spark):
    assert chat.format_trees(spark.createDataFrame([], MESSAGES)).collect() == []
    assert chat.format_chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
