"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table of the lengths of frequent pre-tokens. A byte-level BPE vocabulary
ranks strings by how often they stand in text, so the table holds the vocabulary's own strings, each with
the number of tokens the tokenizer gives it, and needs no pass over the documents; its size is bounded by
the vocabulary, which is checked. Tier two is
each Python worker's cache: a pre-token outside the table is encoded by the tokenizer when the worker
first meets it. Pre-tokens never leave the task that reads them, so there is no shuffle at all.

Defined results: a null text counts as empty (0 bytes, 0 tokens); texts holding a special string, or a
letter, number or unassigned character that Unicode 3.2 didn't have as such, go to the tokenizer whole;
pre-tokens of over CACHE_CHARS characters aren't kept, so very long words take no room; every row gets
one result row, repeated ids included; other input columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.session import ship

#: Entries that a worker's cache may hold beyond the broadcast table, and the longest pre-token kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 96
#: Bound of the broadcast table and of the tokenizer file.
TABLE_ENTRIES, TOKENIZER_BYTES = 300_000, 64_000_000
#: Texts of these characters are cut by a rule with small classes, which is faster; the others by one for all of Unicode.
NARROW, NARROW_ALSO = 0x500, "\\u2010-\\u2027\\u20ac"

_state: dict = {}


def _classes(points: list[int]) -> str:
    """Body of a character class: ranges of code points."""
    out, start, last = [], None, None
    for c in [*points, -2]:
        if start is not None and c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        start, last = c if start is None else start, c
    return "".join(out)


def pretoken_patterns(below: int = 0x110000) -> tuple[re.Pattern, re.Pattern]:
    """The pre-token rule of byte-level BPE, and what finds a character whose class may differ between Unicode releases.

    For texts with characters ``below`` a bound and NARROW_ALSO, which are neither letters nor numbers nor space, a rule with smaller classes is faster.

    Letters and numbers are those that have been such since Unicode 3.2; what is neither now has not been either before.
    """
    kinds: dict[str, list[int]] = {"L": [], "N": [], "": []}
    for c in range(below):
        now, old = unicodedata.category(chr(c))[0], unicodedata.ucd_3_2_0.category(chr(c))[0]
        if now in "LN" and now != old or unicodedata.category(chr(c)) in ("Cn", "Cs"):
            kinds[""].append(c)
        elif now in "LN":
            kinds[now].append(c)
    letters, numbers, unsettled = (_classes(kinds[k]) for k in ("L", "N", ""))
    # Unicode white space: without the separators 1c to 1f, which Python counts
    space = "\\t-\\r \\x85\\xa0" + ("" if below <= NARROW else "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")
    rule = f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(rule), re.compile(f"[{unsettled}]")


def vocabulary_lengths(tokenizer) -> dict[str, int]:
    """Token count of every vocabulary string that is valid text."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    texts = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(back[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    return {t: len(e) for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False))}


def _worker(spec: str, table: dict[str, int]):
    """The tokenizer and cache of this worker process; they outlive a task, and nothing depends on them."""
    key = hash(spec)
    if key not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        rules = [pretoken_patterns(NARROW), pretoken_patterns()]
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _state[key] = (tokenizer, dict(table), special, rules, re.compile(f"[^\\u0000-\\U{NARROW - 1:08x}{NARROW_ALSO}]"))
    return _state[key]


#: The parts of a tokenizer's file that the pre-token rule here stands for.
OWN_RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def cut_as_here(spec: str) -> bool:
    """Whether the file normalizes nothing and cuts pre-tokens by the rule that ``pretoken_patterns`` writes out; of another file whole texts are encoded."""
    d = json.loads(spec)
    rule = d.get("pre_tokenizer") or {}
    return d.get("normalizer") is None and {k: rule.get(k, k == "use_regex") for k in OWN_RULE} == OWN_RULE and not d["model"].get("dropout")


def count_whole(texts: list[str | None], spec: str) -> list[int]:
    """By the tokenizer alone, text by text."""
    tok = _worker(spec, {})[0]
    return [len(tok.encode(t, add_special_tokens=False)) if t else 0 for t in texts]


def count_texts(texts: list[str | None], spec: str, table: dict[str, int]) -> list[int]:
    tok, known, special, rules, wide = _worker(spec, table)
    whole, cut = [], []
    for i, t in enumerate(texts):
        pieces = ()
        if t:
            rule, unsettled = rules[not t.isascii() and wide.search(t) is not None]
            if any(s in t for s in special) or not t.isascii() and unsettled.search(t):
                whole.append(i)
            else:
                pieces = rule.findall(t)
        cut.append(pieces)
    missing = list(set().union(*cut).difference(known)) if cut else []
    if len(known) + len(missing) > len(table) + CACHE_ENTRIES:
        known.clear()
        known.update(table)
        missing = list(set().union(*cut).difference(known))
    known.update((p, len(e)) for p, e in zip(missing, tok.encode_batch_fast(missing, add_special_tokens=False)))
    out = [sum(map(known.__getitem__, c)) for c in cut]
    for i, e in zip(whole, tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
        out[i] = len(e)
    for p in missing:
        if len(p) > CACHE_CHARS:
            del known[p]
    return out


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    own = cut_as_here(spec)
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    table = vocabulary_lengths(tokenizer) if own else {}
    if len(spec) > TOKENIZER_BYTES or len(table) > TABLE_ENTRIES:
        raise ValueError("the tokenizer is larger than what may be broadcast")
    shared = spark.sparkContext.broadcast((spec, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                counts = count_texts(texts, *shared.value) if own else count_whole(texts, shared.value[0])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
        .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
