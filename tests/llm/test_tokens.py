import re

import public_tokenizers
from helpers import docs_table
from tokenizers import Tokenizer

from strandspark.llm import tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello world's  end\n\n\tit'll do ", "x<|endoftext|>y", "naïve café 12½ ²", "漢字かな交じり 文", "՘ odd ￼ \U0001f600!",
    "    x", "'S 's 'Re", "aaaa" * 500, "word " * 3000, "tab\tand\x0bvt\x0cff\x85nel ls", "«q» — “r”…",
]


def truth(text):
    return len(Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False))


def test_counts_equal_the_tokenizer(spark):
    docs = docs_table(spark, TEXTS)
    rows = {r["doc_id"]: r for r in tokens.token_counts(docs, FILE, limit=100).collect()}
    assert len(rows) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        assert rows[k]["n_tokens"] == truth(t), repr(t)
        assert rows[k]["n_bytes"] == len((t or "").encode())
        assert rows[k]["over_limit"] == (truth(t) > 100)


def test_settled_characters_are_cut_as_the_tokenizer_cuts_them():
    rule, unsettled = tokens.pretoken_patterns()
    cut = Tokenizer.from_file(FILE).pre_tokenizer.pre_tokenize_str
    narrow, _ = tokens.pretoken_patterns(tokens.NARROW)
    known = [c for c in [*range(0x10000), *range(0x10000, 0x110000, 7)] if not unsettled.match(chr(c))]
    assert len(known) > 55_000 and set(range(0x370)) - {*map(ord, unsettled.findall("".join(map(chr, range(0x370)))))} <= set(known)
    for c in known:
        s = f"x{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}  y"
        if c < tokens.NARROW or re.match(f"[{tokens.NARROW_ALSO}]", chr(c)):
            assert narrow.findall(s) == rule.findall(s)
        assert [s[i:j] for _, (i, j) in cut(s)] == rule.findall(s), hex(c)


def test_cache_overflow_repeated_rows_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    with open(FILE, encoding="utf-8") as f:
        spec = f.read()
    texts = [f"qx{k} zz{k} unheard{k}" for k in range(50)]
    assert tokens.count_texts(texts, spec, {}) == [truth(t) for t in texts]
    assert tokens.token_counts(docs_table(spark, ["a b", "a b"], [1, 1]), FILE).count() == 2
    assert tokens.token_counts(docs_table(spark, []), FILE).count() == 0


def test_other_scripts_are_cut_by_rule(spark):
    import random

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "ab 1\u0416\u0447\u4e2d\u6587\u0627\u0644\u0967\u0e01\uac00\u3042\u3000\u2003\u2028\u202f.,'s\n\U0001f600\u20ac\u0301\u200d\u2167\u00bd\ufeff"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["\u4e2d" * 5000, "x" * 300_000, "\U00031350\u0870 new letters"]
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    table = tokens.vocabulary_lengths(tok)
    assert tokens.count_texts(texts, spec, table) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    rule, unsettled = tokens.pretoken_patterns()
    assert not unsettled.search(alphabet) and unsettled.search("\u0870")


def test_files_with_other_rules_are_counted_by_the_tokenizer(spark, tmp_path):
    import json

    spec = json.load(open(FILE, encoding="utf-8"))
    for change in ({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}}):
        place = tmp_path / "other.json"
        place.write_text(json.dumps(spec | change), encoding="utf-8")
        other = Tokenizer.from_file(str(place))
        other.no_truncation()
        rows = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs_table(spark, TEXTS), str(place)).collect()}
        for k, t in enumerate(TEXTS):
            want = len(other.encode(t, add_special_tokens=False)) if t else 0
            assert rows[k] == want, (change, t)
