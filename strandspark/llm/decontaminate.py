"""Benchmark decontamination through an FM-index of each training shard.

A task cuts its documents into shards of bounded size. A shard's words become symbols (its own words
that the benchmark has, one symbol for every other word, one for a document's end), and the shard gets a
suffix array, its Burrows-Wheeler transform, a wavelet matrix for ranks and every 32nd suffix position.
Test phrases (windows of ``window`` words, or a shorter item whole) are searched backward together;
surviving rows are located by walking to a sampled position, and their spans are merged by document.

Spark cuts test items to pieces of PIECE_WORDS words, overlapping by a window, and writes them to the
shared folder. Tasks read them there in parts of PART_WORDS words, one after another against a shard's
one index, so neither the driver nor a task holds the benchmark; up to KEPT_BYTES of it a worker keeps
what it has read, and indexes only its words. Documents pass once and aren't shuffled.

Defined results: null and empty texts have no words, no hits and no items; items with a null id or
without words are ignored; rows of one item id count as one item; every document row gets a row,
repeated ids included; a very long document is a shard of its own; columns whose names the result adds
can't be kept (``drop_contaminated`` keeps columns of any name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import free_name
from strandspark.session import ship, write_scratch

WINDOW = 13
#: Words and documents of a shard, words of a part and of a piece of the test items, bytes of items that a worker keeps, rows between samples.
SHARD_WORDS, SHARD_DOCS, PART_WORDS, PIECE_WORDS, KEPT_BYTES, SAMPLE = 250_000, 100_000, 300_000, 20_000, 16_000_000, 32
END, OTHER, FIRST = 0, 1, 2

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isupper() else b if b in _KEEP else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


class Ranks:
    """Number of ones before a position of a bit array."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.shifts = range(max(1, int(sigma - 1).bit_length()))[::-1]
        self.levels, self.zeros = [], []
        for s in self.shifts:
            bits = ((symbols >> s) & 1).astype(bool)
            self.levels.append(Ranks(bits))
            self.zeros.append(len(bits) - int(np.count_nonzero(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for s, ranks, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = ranks(at)
            at = np.where((symbol >> s) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling from as many symbols on as 63 bits hold; every document end is smaller than what follows it and than later ends."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == END)
    first = symbols.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    width = int(first.max(initial=0) + 1).bit_length()
    h = min(3, 63 // width)
    padded = np.concatenate([first + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << width | padded[k : n + k]
    sa = np.argsort(key, kind="stable")
    rank, slots = np.empty(n, np.int64), np.arange(n)
    key = key[sa]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        start = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[sa[slots]] = start
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        if not len(slots):
            return sa
        at = sa[slots]
        beyond = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        sa[slots], key = at[order], key[order]
        h *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        sa = suffix_array(symbols)
        self.bwt = symbols[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])[:sigma]
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        kept = (sa % SAMPLE == 0) | (self.bwt == END)
        self.sampled, self.positions, self.kept = Ranks(kept), sa[kept], kept

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases that occur (rows padded on the left): their numbers and row ranges."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        width = phrases.shape[1]
        for k in range(width - 1, -1, -1):
            c = phrases[alive, k]
            use = lengths[alive] >= width - k
            sym = np.where(use, c, OTHER)
            new_lo = self.less[sym] + self.wavelet.rank(sym, lo)
            new_hi = self.less[sym] + self.wavelet.rank(sym, hi)
            lo, hi = np.where(use, new_lo, lo), np.where(use, new_hi, hi)
            on = lo < hi
            alive, lo, hi = alive[on], lo[on], hi[on]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept[out])
        while len(walking):
            c = self.bwt[out[walking]]
            out[walking] = self.less[c] + self.wavelet.rank(c, out[walking])
            steps[walking] += 1
            walking = walking[~self.kept[out[walking]]]
        return self.positions[self.sampled(out)] + steps


class Phrases:
    """Distinct windows of test items over a part's own vocabulary, and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, ws in items:
            for k in range(max(1, len(ws) - window + 1)):
                found.setdefault(tuple(ws[k : k + window]), set()).add(item)
        self.words = sorted({w for p in found for w in p})
        place = {w: i for i, w in enumerate(self.words)}
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.array([[-1] * (window - len(p)) + [place[w] for w in p] for p in found], np.int64).reshape(-1, window)
        self.items = [sorted(s) for s in found.values()]


Hits = tuple[int, list[tuple[int, int]], set[str]]


def scan_shard(docs: list[list[bytes]], parts: Iterable[Phrases], known: set[bytes] | None = None) -> list[Hits]:
    """Per document of the shard: its number of words, the merged spans of hit words, the items found.

    ``known``: the words of all parts, if they are at hand; others needn't be told apart then.
    """
    out: list[Hits] = [(len(ws), [], set()) for ws in docs]
    own = set().union(*docs)
    symbol = {w: FIRST + i for i, w in enumerate(sorted(own if known is None else own & known))}
    if not symbol:
        return out
    flat: list[int] = []
    for ws in docs:
        flat += [symbol.get(w, OTHER) for w in ws]
        flat.append(END)
    text = np.array(flat, np.int64)
    del flat
    starts = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in docs])])
    index, cover = None, np.zeros(len(text) + 1, np.int64)
    for part in parts:
        here = np.array([*(symbol.get(w, -1) for w in part.words), OTHER], np.int64)[part.rows]
        on = np.flatnonzero((here >= 0).all(1))  # a phrase with a word that the shard lacks can't occur
        if not len(on):
            continue
        index = index or FMIndex(text, FIRST + len(symbol))
        found, lo, hi = index.search(here[on], part.lengths[on])
        if not len(found):
            continue
        found, times = on[found], hi - lo
        ends = np.cumsum(times)
        for first in range(0, len(found), 4_096):  # a phrase of few words may stand in very many places
            some = slice(first, first + 4_096)
            t = times[some]
            number = np.repeat(found[some], t)
            rows = np.repeat(lo[some] - (ends[some] - t - (ends[first] - times[first])), t) + np.arange(t.sum())
            at = index.locate(rows)
            cover += np.bincount(at, minlength=len(text) + 1) - np.bincount(at + part.lengths[number], minlength=len(text) + 1)
            for pair in np.unique((np.searchsorted(starts, at, "right") - 1) * len(part.rows) + number):
                out[pair // len(part.rows)][2].update(part.items[pair % len(part.rows)])
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        d = int(np.searchsorted(starts, a, "right")) - 1
        out[d][1].append((int(a - starts[d]), int(b - starts[d])))
    return out


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """Batches put together, and cut, to shards; a longer document is a shard of its own."""
    held: list[pa.RecordBatch] = []
    docs: list[list[bytes]] = []
    size = 0
    for b in batches:
        column, begin = b.column(text).cast(pa.binary()), 0
        for i in range(b.num_rows):
            docs.append(words(column[i].as_py()))
            size += len(docs[-1]) + 1
            if size >= SHARD_WORDS or len(docs) >= SHARD_DOCS:
                yield pa.Table.from_batches([*held, b.slice(begin, i + 1 - begin)]), docs
                held, docs, size, begin = [], [], 0, i + 1
        if begin < b.num_rows:
            held.append(b.slice(begin))
    if docs:
        yield pa.Table.from_batches(held), docs


def write_items(items: DataFrame, id_col: str, text_col: str, window: int) -> str:
    """Test items in pieces (item, words), as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                cut = [b" ".join(ws[k : k + PIECE_WORDS + window - 1]) for k in range(0, max(1, len(ws) - window + 1), PIECE_WORDS)] if ws else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.binary())], names=["item", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).where("item is not null and text is not null")
    return write_scratch(rows.mapInArrow(run, "item string, words binary"), "benchmark-items")


_kept: dict[str, tuple[list[Phrases], set[bytes]]] = {}


def _stream(place: str, window: int) -> Iterator[Phrases]:
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for b in parquet_dataset(place).to_batches(batch_size=64, columns=["item", "words"]):
        for item, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.append((item, ws.split()))
            size += len(held[-1][1])
            if size >= PART_WORDS:
                yield Phrases(held, window)
                held, size = [], 0
    if held:
        yield Phrases(held, window)


def parquet_dataset(place: str) -> dataset.Dataset:
    where, path = fs.FileSystem.from_uri(place)
    return dataset.dataset(path, filesystem=where, format="parquet", exclude_invalid_files=True)


def _parts(place: str, n_bytes: int, window: int) -> tuple[Iterable[Phrases], set[bytes] | None]:
    """Parts of the written items and, if they are few enough to be kept by this worker, all their words."""
    if n_bytes > KEPT_BYTES:
        return _stream(place, window), None
    if place not in _kept:
        _kept.clear()
        parts = list(_stream(place, window))
        _kept[place] = (parts, {w for p in parts for w in p.words})
    return _kept[place]


def mark(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", id_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``keep`` columns of ``docs`` and ``n_words``, merged ``spans`` of hit words and sorted ``items``."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(*keep)
    text = text_col if text_col in keep else free_name(base, "hit_text")
    rows = base if text in keep else docs.select(*keep, F.col(text_col).cast("string").alias(text))
    at, kept = rows.columns.index(text), len(keep)
    names = [free_name(base, n) for n in ("hit_n", "hit_spans", "hit_items")]
    kinds = ["long", "array<struct<start:int,stop:int>>", "array<string>"]
    out = base.select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)])
    place = write_items(items, id_col, item_text, window)
    n_bytes = spark.read.schema("item string, words binary").parquet(place).agg(F.sum(F.length("words"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]
        for table, texts in _shards(batches, at):
            found = scan_shard(texts, *_parts(place, n_bytes, window))
            columns = [[h[0] for h in found], [[{"start": a, "stop": b} for a, b in h[1]] for h in found], [sorted(h[2]) for h in found]]
            table = table.select(table.column_names[:kept])
            for name, values, kind in zip(names, columns, types):
                table = table.append_column(name, pa.array(values, kind))
            yield from table.to_batches(max_chunksize=512)

    return rows.mapInArrow(run, out.schema).select(*keep, *[F.col(n).alias(new) for n, new in zip(names, ("n_words", "spans", "items"))])


def contaminated(docs: DataFrame, items: DataFrame, keep: list[str], **options) -> DataFrame:
    """``mark`` and, for each document, ``n_hit`` and ``contaminated``: at least a twentieth of its words are hit."""
    own = {"n_words", "spans", "items", "n_hit", "contaminated"}
    if taken := own.intersection(c.lower() for c in keep):
        raise ValueError(f"keep has columns that the result adds: {sorted(taken)}")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return (
        mark(docs, items, keep, **options)
        .withColumn("n_hit", hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def brute(doc: str | None, items: dict[str, str | None], window: int = WINDOW) -> tuple[int, int, list[str], str, bool]:
    """What the contract asks for, by comparing every position: for tests."""
    ws = words(doc.encode() if doc is not None else None)
    hit, names = [False] * len(ws), set()
    for item, text in items.items():
        iw = words(text.encode() if text is not None else None)
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            p = iw[k : k + window]
            for i in range(len(ws) - len(p) + 1):
                if ws[i : i + len(p)] == p:
                    hit[i : i + len(p)] = [True] * len(p)
                    names.add(item)
    n = sum(hit)
    return len(ws), n, sorted(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0 and 20 * n >= len(ws)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they were."""
    names = [free_name(docs, f"column_{k}") for k in range(len(docs.columns))]
    text = names[docs.columns.index(options.pop("text_col", "text"))]
    found = contaminated(docs.toDF(*names), items, names, text_col=text, **options)
    return found.where("not contaminated").select(names).toDF(*docs.columns)
