import random

from helpers import docs_table

from strandspark.llm import common
from strandspark.llm import line_dedup as ld


def plain_blocks(lines, least):
    """Every run of lines with enough words that has too few without its first or without its last line, by (start, stop)."""
    words = [len(x.split()) for x in lines]
    runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if sum(words[i:j]) >= least]
    return [(i, j) for i, j in runs if sum(words[i : j - 1]) < least or sum(words[i + 1 : j]) < least]


def plain_chain(pairs):
    """A longest increasing chain by trying every pair of pairs; of several, what comes last."""
    size, back = [], []
    for k, (_, b) in enumerate(pairs):
        size.append(1 + max((size[m] for m in range(k) if pairs[m][1] < b), default=0))
        back.append(max((m for m in range(k) if size[m] == size[k] - 1), default=None))
    k = max((k for k in range(len(pairs)) if size[k] == max(size)), default=None)
    out = []
    while k is not None:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def plain_patience(x, y):
    """Matches of two sequences, by recursion."""
    if not x or not y:
        return []
    if x[0] == y[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_patience(x[1:], y[1:])]
    if x[-1] == y[-1]:
        return plain_patience(x[:-1], y[:-1]) + [(len(x) - 1, len(y) - 1)]
    common = [v for v in dict.fromkeys(x) if v in y]
    rarest = min((x.count(v) * y.count(v) for v in common), default=0)
    chain = plain_chain([(x.index(v), y.index(v)) for v in common if x.count(v) * y.count(v) == rarest])
    out, i, j = [], 0, 0
    for a, b in chain:
        out += [(i + p, j + q) for p, q in plain_patience(x[i:a], y[j:b])] + [(a, b)]
        i, j = a + 1, b + 1
    return out + [(i + p, j + q) for p, q in plain_patience(x[i:], y[j:])] if chain else out


def plain(texts, min_words, union=False):
    """Every document's blocks against every earlier one's; ``union`` takes all shared blocks without an alignment."""
    seqs = [[x.strip() for x in (t or "").split("\n") if x.strip()] for t in texts]
    runs = [plain_blocks(s, min_words) for s in seqs]
    keys = [[tuple(s[i:j]) for i, j in r] for s, r in zip(seqs, runs)]
    out = []
    for d, t in enumerate(texts):
        gone = set()
        for e in range(d):
            mine = [k for k, x in enumerate(keys[d]) if x in keys[e] and not any(x in keys[f] for f in range(e))]
            theirs = sorted({keys[d][k] for k in mine}, key=lambda x: runs[e][keys[e].index(x)])
            x = [keys[d][k] for k in mine]
            matched = set(x) if union else {x[i] for i, _ in plain_patience(x, theirs)}
            gone.update(n for k in mine if keys[d][k] in matched for n in range(*runs[d][k]))
        left, at = [], -1
        for x in (t or "").split("\n"):
            at += bool(x.strip())
            if not x.strip() or at not in gone:
                left.append(x)
        out.append((None if t is None else t if not gone else "\n".join(left) if any(x.strip() for x in left) else "", len(gone)))
    return out


def check(spark, texts, min_words):
    rows = {r["doc_id"]: r for r in ld.remove_repeats(docs_table(spark, texts), min_words=min_words).collect()}
    for k, (t, n) in enumerate(plain(texts, min_words)):
        assert (rows[k]["text"], rows[k]["lines_removed"]) == (t, n), (k, texts[k])


def test_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 9))) for _ in range(25)]
    texts = ["\n".join(rng.choice([*lines, "", f"own {rng.random()} words"]) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts = list(dict.fromkeys(texts)) + [None]
    check(spark, texts, 6)
    assert plain(texts, 6) != plain(texts, 6, union=True)
    monkeypatch.setattr(common, "HOT_ROWS", 3)  # common blocks take the other join
    check(spark, texts, 6)


def test_copies_of_documents_put_together_from_others_go(spark):
    one, two = "aa bb cc dd ee ff", "gg hh ii jj kk ll"
    texts = [one, two, f"{one}\n{two}", f"{one}\n{two}", f"{two}\n{one}"]
    check(spark, texts, 10)
    rows = {r["doc_id"]: r for r in ld.remove_repeats(docs_table(spark, texts)).collect()}
    assert [rows[k]["lines_removed"] for k in range(5)] == [0, 0, 0, 2, 0]


def test_passages_go_from_later_documents_only(spark):
    passage = "\n".join(" ".join(f"p{k}x{j}" for j in range(20)) for k in range(4))
    moved = "\n".join(passage.split("\n")[::-1])
    texts = [f"begin\n{passage}\nend", f"other start\n{passage}\ntail of its own", f"again\n{moved}", "All rights reserved.\nnothing else", "All rights reserved.\nsomething new", f"x\n{passage}\n\n{passage}"]
    check(spark, texts, ld.MIN_WORDS)
    rows = {r["doc_id"]: r["text"] for r in ld.remove_repeats(docs_table(spark, texts)).collect()}
    assert rows[0] == texts[0] and rows[3] == texts[3] and rows[4] == texts[4]
    assert rows[1] == "other start\ntail of its own"
    assert rows[2] == "again\n" + "\n".join(moved.split("\n")[:3])  # of reversed lines one is the chain
    assert "p0x0" not in rows[5]


def test_passages_in_the_opposite_order_stay(spark):
    a, b, c = ("\n".join(" ".join(f"{n}{k}x{j}" for j in range(12)) for k in range(lines)) for n, lines in (("a", 3), ("b", 2), ("c", 1)))
    texts = [f"{a}\n{b}\n{c}", f"{b}\nown words\n{a}\n{c}", f"{c}\n{b}\n{b}"]
    check(spark, texts, 10)
    rows = {r["doc_id"]: r["text"] for r in ld.remove_repeats(docs_table(spark, texts)).collect()}
    assert rows == {0: texts[0], 1: f"{b}\nown words", 2: f"{b}\n{b}"}  # c is unique in both


def test_alignment_is_patience_diff():
    rng = random.Random(8)
    for _ in range(3000):
        letters = rng.randint(1, 9)
        a, b = [rng.randrange(letters) for _ in range(rng.randint(0, 14))], [rng.randrange(letters) for _ in range(rng.randint(0, 14))]
        assert ld.align(a, b) == plain_patience(a, b)


def test_align_is_increasing_and_equal():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randint(0, 15))], [rng.randrange(6) for _ in range(rng.randint(0, 15))]
        m = ld.align(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
        assert bool(m) == bool(set(a) & set(b))


def test_edges(spark):
    long = "\n".join(f"line {k} " + "word " * 12 for k in range(3000))
    texts = [long, long + "\nmore", "dup " * 12, "dup " * 12, None, "", " \n "]
    docs = docs_table(spark, texts, [0, 1, 2, 2, 4, 5, None]).withColumnRenamed("lang", "gone_lines").withColumnRenamed("source", "lines_removed")
    out = ld.remove_repeats(docs)
    assert out.columns == [*docs.columns, "lines_removed_"]
    rows = out.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7 and by[1]["text"] == "more" and by[1]["lines_removed_"] == 3000
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [texts[2]] * 2
    assert by[4]["text"] is None and by[None]["text"] == " \n "
    assert ld.remove_repeats(docs.limit(0)).count() == 0


def test_reversed_long_documents_end_soon(spark):
    lines = [f"line {k} " + "word " * 12 for k in range(4000)]
    texts = ["\n".join(lines), "\n".join(lines[::-1]), "\n".join(["same " * 12] * 4000), "\n".join(["same " * 12] * 4001)]
    rows = {r["doc_id"]: r["lines_removed"] for r in ld.remove_repeats(docs_table(spark, texts)).collect()}
    assert rows == {0: 0, 1: 1, 2: 0, 3: 4001}
