"""Periodic runs of words by Lyndon arrays over an ordered alphabet, after Ellert and Fischer.

A run is a maximal stretch of words with a smallest period p that it holds several times over. Every run has
a root, a shortest Lyndon word of the words' order or of the reversed order, that ends where the next smaller
suffix begins; so all runs are found from the edges between suffixes and their next smaller ones in both orders
and from how far the two ends of an edge match.

One pass from left to right finds the edges with a stack of suffixes that are smaller than all since. It
compares suffixes i < j by their common prefix, and never matches a word twice: the last comparison that
reached furthest right, of x and y up to ``reach``, has shown that what follows y up to there repeats what
follows x. Within that window the same comparison, moved by y - x to the left, was made before: if it ended
inside the window its length holds again; else the two agree up to ``reach`` and matching goes on from there.
So matching costs one step a word, whatever the text. There are no suffix arrays or trees, no prefix hashes.

An edge of period p that matches for more than p words beyond it belongs to a run of three periods or more;
its start is matched leftwards from its first root, less than a period. Words are numbered in the order in
which a batch of documents has them: any order will do. A word that a stretch has fewer times than a run must
repeat can't be in a run, so stretches end there and are cut again until nothing changes; what is left is
searched. Documents are rows of an Arrow stage: nothing is shuffled, and a lost executor costs a retry.

Defined results: words are separated by ASCII white space; null and empty texts have no words and no runs,
and an empty collapsed text; a null id stays null; repeated rows are judged each; very long texts are read
whole; ties don't arise, since runs of one start and period are one run; an empty table gives an empty table;
only the id and text columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.session import ship

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Bytes of text that are searched together; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the place of the next smaller one (``len(w)`` if none) and the length of their common prefix."""
    n = len(w)
    after, after_match = [n] * n, [0] * n
    before, before_match = [-1] * n, [0] * n
    shift = window = reach = 0  # words from ``window`` up to ``reach`` repeat those ``shift`` earlier
    for j in range(1, n):
        i = j - 1
        while i >= 0:
            known = reach - j
            if known > 0:
                a = j - shift
                b = i - shift if i >= window else i
                if i >= window and after[b] == a:
                    match = after_match[b]
                elif before[a] == b:
                    match = before_match[a]
                else:
                    match = known
            else:
                match = known = 0
            if match >= known:
                k = j + known
                back = j - i
                while k < n and w[k] == w[k - back]:
                    k += 1
                match = k - j
                shift, window, reach = back, j, k
            if j + match == n or w[j + match] < w[i + match]:
                after[i], after_match[i] = j, match
                i = before[i]
            else:
                before[j], before_match[j] = i, match
                break
    return after, after_match


def find_runs(words: list[int], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` words and ``min_exponent`` (3 or more) periods, by start and period."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods aren't looked for")
    found = set()
    for w in (words, [-x for x in words]):
        after, match = next_smaller(w)
        for i, j in enumerate(after):
            p, m = j - i, match[i]
            if m <= p or (i >= p and after[i - p] == i and match[i - p] == m + p):
                continue  # too short, or a later root of a run that is known
            start = i
            while start and w[start - 1] == w[start - 1 + p]:
                start -= 1
            length = j + m - start
            if length >= min_length and length >= min_exponent * p:
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, docs: np.ndarray, times: int, min_length: int) -> Iterator[tuple[int, int]]:
    """[start, stop) of the stretches of ``words`` within a document whose every word occurs ``times`` times or more in its stretch."""
    at, part = np.arange(len(words)), docs
    while True:
        key = part.astype(np.int64) * (int(words.max(initial=0)) + 1) + words[at]
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        keep = n[inverse] >= times
        fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1) | ~keep[:-1]])[: len(at)]
        new = np.cumsum(fresh)[keep]
        at_kept = at[keep]
        if len(new):
            names, inverse, n = np.unique(new, return_inverse=True, return_counts=True)
            long = n[inverse] >= min_length
            new, at_kept = new[long], at_kept[long]
        if len(at_kept) == len(at):
            break
        at, part = at_kept, new
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(at[a]), int(at[b - 1]) + 1


def batch_runs(texts: pa.Array, min_exponent: int, min_length: int) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs of each text, and each text without the repeats, its words joined by single spaces."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    docs = pc.list_parent_indices(lists).to_numpy()
    words = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(words), 0)
    words, docs = words.filter(full), docs[full.to_numpy(zero_copy_only=False)]
    ends = np.searchsorted(docs, np.arange(len(texts) + 1))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    kept = np.ones(len(codes), bool)
    for a, b in stretches(codes, docs, min_exponent, min_length):
        doc = int(docs[a])
        for start, length, p in find_runs(codes[a:b].tolist(), min_exponent, min_length):
            runs[doc].append((int(start + a - ends[doc]), length, p))
            kept[a + start + p : a + start + length] = False
    offsets = np.concatenate([[0], np.cumsum(kept)])[ends]
    left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept)))
    return runs, pc.binary_join(left, " ").to_pylist()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, runs, collapsed) for each row: its runs by start and period, and its words without those that repeat a run's first period."""
    ship(docs.sparkSession)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // BATCH_BYTES, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], whole.num_rows]):
                part = whole.slice(a, b - a)
                runs, left = batch_runs(part.column(1).cast(pa.string()), min_exponent, min_length)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in sorted(r, key=lambda r: (r[0], r[2]))] for r in runs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, spans), pa.array(left, pa.string())], names=[part.schema.names[0], "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)
