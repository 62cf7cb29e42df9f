"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of orders 1 to n (trigrams by default) and an add-half unigram base are mixed
with weights that depend on the longest context seen and the bucket of its frequency. The weights come
from expectation-maximisation over held-out counts: a part of the training documents is deleted from the
counts, and each of its tokens falls into a cell (context bucket, rounded estimate of every order); cells
are few whatever the corpus.

Counting and scoring move n-grams, not tokens. A task encodes its documents into blocks (written once
to the shared folder). A block sends each distinct n-gram once, as a sorted hash with its counts,
cut by hash range into buckets whose number follows the corpus; a bucket adds up and answers in the
order asked, so a block gets the counts of its own n-grams back. No key can be hot: within a block it
occurs once. Words have 60-bit hashes; longer n-grams SPARE bits more than the number of tokens, so at
any size one in 2 ** SPARE meets another's count, which touches the mixture only.

A row carries an n-gram block's share of a bucket: some hundred n-grams at tens of gigabytes, fewer the
larger the corpus is.

Defined results: a null text is empty and has one token, the end; rows with a null id are scored, not
learned and not held out; rows that repeat an id are documents each; a very long text makes a block of
its own; other columns are not read, whatever their names; with nothing to learn from, the base gives
every token probability one; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.session import drop, ship, write_scratch

#: Tokens of a block, n-grams of an exchange bucket, bits of a word's hash and those of a longer n-gram's beyond the corpus's.
BLOCK, BUCKET, BITS, SPARE = 1_200_000, 3_000_000, 60, 12
#: Partitions of an exchange at most.
MOST_PARTITIONS = 100_000
#: Shares of the blocks that get their counts back one after another.
SHARES = 4
END, START = 0, 1
TRAIN, TUNE = 1, 2


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, lowest first, without planes that are all zero."""
    wide = int(values.max()).bit_length() if len(values) else 0
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-wide // 8)].T).tobytes()


def squeeze(values: np.ndarray) -> bytes:
    """``pack`` with a Huffman code for what lies above the two lowest planes: it takes few values."""
    low, high = values & np.uint64(0xFFFF), pack(values >> np.uint64(16))
    c = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return low.astype("<u2").tobytes() + c.compress(high) + c.flush()


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data[: 2 * n], "<u2").astype(np.uint64)
    return low | unpack(zlib.decompress(data[2 * n :], -15), n) << np.uint64(16)


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def encode(docs: DataFrame, id_col: str, text_col: str, part: Column) -> DataFrame:
    """Blocks (block, n_tokens, ids, hashes, doc_ids, lengths, parts); ``part`` of a document is 0, TRAIN or TRAIN + TUNE."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        made = 0

        def block():
            nonlocal made
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            hashes = np.array([xxh64_intdigest(b"", 1), xxh64_intdigest(b"", 2), *[xxh64_intdigest(w) for w in known]], np.uint64)
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            columns = [[number], [len(ids)], [pack(ids)], [hashes.tobytes()], [doc_ids], [lengths], [parts]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names = ["block", "n_tokens", "ids", "hashes", "doc_ids", "lengths", "parts"]
        types = None
        known: dict[bytes, int] = {}
        held, doc_ids, lengths, parts, size = [], [], [], [], 0
        for b in batches:
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(b.schema.field(0).type), pa.list_(pa.int32()), pa.list_(pa.int32())]
            texts = b.column(1).cast(pa.binary())
            for key, text, part_ in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist()):
                new = known.setdefault
                ws = [new(w, len(known) + 2) for w in tokens(text.as_py())]
                ws.append(END)
                held.append(np.array(ws, np.uint32))
                doc_ids.append(key)
                lengths.append(len(ws))
                parts.append(part_)
                size += len(ws)
                if size >= BLOCK:
                    yield block()
                    known = {}
                    held, doc_ids, lengths, parts, size = [], [], [], [], 0
        if doc_ids:
            yield block()

    schema = f"block long, n_tokens long, ids binary, hashes binary, doc_ids array<{kind}>, lengths array<int>, parts array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), part.cast("int").alias("part")).mapInArrow(run, schema)


class Block:
    """One encoded block's n-grams: for each order, their distinct sorted hashes and each position's place among them."""

    def __init__(self, ids: bytes, hashes: bytes, lengths: list[int], parts: list[int]):
        self.word = np.frombuffer(hashes, np.uint64)
        self.lengths = np.array(lengths, np.int64)
        self.ids = unpack(ids, int(self.lengths.sum())).astype(np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.part = np.repeat(np.array(parts, np.int64), self.lengths)

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = self.word[self.ids].copy()
        before = self.ids
        for _ in range(order - 1):
            before = np.concatenate([[START], before[:-1]]).astype(np.uint32)
            before[self.starts] = START
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + self.word[before]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)
        return np.unique(h, return_inverse=True)

    def counts(self, place: np.ndarray, n: int, part: int) -> np.ndarray:
        return np.bincount(place[(self.part & part) > 0], minlength=n)


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for k in range(table.num_rows):
        yield {name: table.column(i)[k].as_py() for i, name in enumerate(table.schema.names)}


def widths(order: int, n_tokens: int) -> dict[int, int]:
    """Bits of the hashes of each order."""
    return {k: BITS if k == 1 else min(BITS, n_tokens.bit_length() + SPARE) for k in range(1, order + 1)}


def ask(blocks: DataFrame, order: int, width: int, buckets: int) -> DataFrame:
    """A row for each block and bucket: the hashes of the block's n-grams of one order and their counts in it."""
    schema = pa.schema([("order", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("tune", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << width) // buckets for k in range(buckets)] + [1 << width], np.uint64)
        for batch in batches:
            for r in _rows(batch):
                block = Block(r["ids"], r["hashes"], r["lengths"], r["parts"])
                keys, place = block.grams(order, width)
                train, tune = (block.counts(place, len(keys), p) for p in (TRAIN, TUNE))
                cut = np.searchsorted(keys, edges)
                out = []
                for k in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[k], cut[k + 1])
                    gaps = np.diff(keys[s], prepend=edges[k])
                    out.append((order, int(k), r["block"], len(gaps), squeeze(gaps), pack(train[s]), pack(tune[s])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return blocks.select("block", "ids", "hashes", "lengths", "parts").mapInArrow(run, "order int, bucket long, block long, n long, keys binary, train binary, tune binary")


def partitions(groups: int, df: DataFrame) -> int:
    """As many as there are groups, so that a task's share doesn't grow with the corpus; within what a shuffle can have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, MOST_PARTITIONS))


def answer(asked: DataFrame, width: int, buckets: int) -> DataFrame:
    """For each row asked, the corpus counts in the same order; one more row a bucket (block null) has its totals."""
    schema = pa.schema([("order", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("train", pa.binary()), ("tune", pa.binary()), ("totals", pa.list_(pa.int64()))])

    def run(key, table):
        _, order, bucket = (k.as_py() for k in key)
        low = np.uint64((bucket << width) // buckets)
        rows = list(_rows(table.select(["block", "n", "keys", "train", "tune"])))
        keys = np.concatenate([np.cumsum(unsqueeze(r["keys"], r["n"])) + low for r in rows])
        _, place = np.unique(keys, return_inverse=True)
        train, tune = (np.bincount(place, np.concatenate([unpack(r[c], r["n"]) for r in rows])).astype(np.int64) for c in ("train", "tune"))
        out, at = [], 0
        for r in rows:
            p = place[at : at + r["n"]]
            at += r["n"]
            out.append((order, bucket, r["block"], r["n"], pack(train[p]), pack(tune[p]), None))
        kept = train - tune
        out.append((order, bucket, None, 0, None, None, [int(train.sum()), int((train > 0).sum()), int(kept.sum()), int((kept > 0).sum())]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    # placed by number and not by hash: as many groups in each partition
    n = partitions(buckets, asked)
    dealt = asked.withColumn("slot", F.pmod("bucket", F.lit(n)).cast("int")).repartitionById(n, F.col("slot"))
    return dealt.groupBy("slot", "order", "bucket").applyInArrow(run, "order int, bucket long, block long, n long, train binary, tune binary, totals array<long>")


def context_bucket(counts: list[np.ndarray]) -> np.ndarray:
    """64 for each longer context seen, and 1 + floor(log2(count)) of the longest; 0 if none is. ``counts``: of the contexts of orders 2 and up."""
    out = np.zeros(len(counts[0]) if counts else 0, np.int64)
    for level, count in enumerate(counts):
        out = np.where(count > 0, 64 * level + 1 + np.log2(np.maximum(count, 1)).astype(np.int64), out)
    return out


def _level(p: np.ndarray) -> np.ndarray:
    """Half octaves of a probability; 255: zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(-2 * np.log2(np.maximum(p, 1e-38)), 254), 255).astype(np.int64)


def estimates(counts: list[np.ndarray], starts: np.ndarray, n_docs: float, total: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts of the n-gram ending at each position, by order: the counts of its contexts of orders 2 and up, and the estimates of every order.

    A context that reaches before the text's beginning is counted by documents.
    """
    out, contexts = [counts[0] / total if total else np.zeros(len(counts[0]))], []
    for lower, here in zip(counts, counts[1:]):
        context = np.concatenate([[0], lower[:-1]]).astype(np.float64)
        context[starts] = n_docs
        contexts.append(context)
        out.append(np.divide(here, context, out=np.zeros(len(here)), where=context > 0))
    return contexts, out


class Mixture:
    """Weights of base and orders 1 to n for each context bucket, learned from cells of held-out tokens."""

    def __init__(self, order: int, cells: dict[int, int], kept_tokens: float, kept_types: float, rounds: int = 60, least: float = 1e-4):
        keys = np.array(list(cells), np.int64)
        weight = np.array(list(cells.values()), np.float64)
        bucket = keys >> (8 * order)
        levels = [(keys >> (8 * k)) & 255 for k in range(order)]
        p = [np.where(v == 255, 0, 2.0 ** (-(v + 0.5) / 2)) for v in levels]
        p = np.stack([(p[0] * kept_tokens + 0.5) / (kept_tokens + 0.5 * (kept_types + 1)), *p])
        overall = self._learn(np.full(order + 1, 1 / (order + 1)), weight, p, rounds, least)
        self.weights = np.tile(overall, (64 * max(1, order - 1), 1))
        for b in range(len(self.weights)):
            on = bucket == b
            mix = self._learn(overall, weight[on], p[:, on], rounds, least)
            seen = 0 if b == 0 else 1 + b // 64  # contexts beyond those seen have no estimate
            mix[2 + seen :] = 0
            self.weights[b] = mix / mix.sum()

    @staticmethod
    def _learn(mix: np.ndarray, weight: np.ndarray, p: np.ndarray, rounds: int, least: float) -> np.ndarray:
        """Expectation-maximisation from ``mix`` on: each component's share of the tokens."""
        for _ in range(rounds if weight.sum() else 0):
            share = mix[:, None] * p
            mix = np.maximum((share / np.maximum(share.sum(0), 1e-300) * weight).sum(1) / weight.sum(), least)
            mix /= mix.sum()
        return mix.copy()

    def __call__(self, base: np.ndarray, contexts: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
        w = self.weights[context_bucket(contexts) if contexts else np.zeros(len(base), np.int64)]
        return sum((w[:, k + 1] * p for k, p in enumerate(parts)), w[:, 0] * base)


def _annotate(blocks: DataFrame, answers: DataFrame, bits: dict[int, int], n_kept: int, kept: tuple[int, int], kind: str, n_blocks: int) -> DataFrame:
    """Each block's counts by position, and the cells of its held-out tokens."""
    order = len(bits)

    def run(left, right):
        r = next(_rows(left))
        block = Block(r["ids"], r["hashes"], r["lengths"], r["parts"])
        replies = sorted(_rows(right.select(["order", "bucket", "n", "train", "tune"])), key=lambda x: (x["order"], x["bucket"]))
        train, rest = [], []
        for k in range(1, order + 1):
            _, place = block.grams(k, bits[k])
            mine = [x for x in replies if x["order"] == k]
            c, t = (np.concatenate([unpack(x[name], x["n"]) for x in mine]).astype(np.int64)[place] for name in ("train", "tune"))
            train.append(c)
            rest.append(c - t)
        tuned = (block.part & TUNE) > 0
        contexts, parts = estimates(rest, block.starts, n_kept, kept[0])
        cell = context_bucket([c[tuned] for c in contexts]) if order > 1 else np.zeros(int(tuned.sum()), np.int64)
        for p in reversed(parts):
            cell = (cell << 8) | _level(p[tuned])
        cells, times = np.unique(cell, return_counts=True)
        columns = [r["doc_ids"], r["lengths"], r["parts"], [pack(c) for c in train], cells.tolist(), times.tolist()]
        return pa.table([pa.array([c], t) for c, t in zip(columns, [left.schema.field("doc_ids").type, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())])], names=["doc_ids", "lengths", "parts", "counts", "cells", "times"])

    n = partitions(n_blocks, blocks)
    return blocks.repartition(n, "block").groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(run, f"doc_ids array<{kind}>, lengths array<int>, parts array<int>, counts array<binary>, cells array<long>, times array<long>")


def _slices(lengths: np.ndarray, size: int = 100_000) -> Iterator[tuple[int, int]]:
    """Runs of documents (first, last + 1) of some ``size`` tokens, one document at least."""
    first = total = 0
    for k, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield first, k
            first, total = k, 0
        total += n
    if len(lengths):
        yield first, len(lengths)


def score(docs: DataFrame, learn: Column, held_out: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """Per document: ``held_out``, token figures, ``base_score`` and the mixture's ``score``, both log10.

    ``learn`` and ``tune`` (a part of the former that estimates the weights) are conditions on ``docs``.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    true = lambda c: F.coalesce(c, F.lit(False))
    part = F.when(true(learn) & true(tune), TRAIN + TUNE).when(true(learn), TRAIN).otherwise(0) + F.when(true(held_out), 4).otherwise(0)
    encoded = write_scratch(encode(docs, id_col, text_col, part), "lm-blocks")
    blocks = spark.read.parquet(encoded)
    size = blocks.agg(
        F.sum("n_tokens"),
        F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.bitwiseAND(F.lit(TRAIN)))),
        F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(p.bitwiseAND(F.lit(TUNE)) > 0, 1).otherwise(0))),
    ).first()
    n_tokens, n_train, n_tune = (x or 0 for x in size)
    buckets = max(1, -(-n_tokens // BUCKET))
    bits = widths(order, n_tokens)
    # an order's exchange is gone before the next one's, and so is that of a share of the blocks
    answered = [write_scratch(answer(ask(blocks, k, width, buckets), width, buckets), "lm-counts") for k, width in bits.items()]
    totals = spark.read.parquet(answered[0]).where("block is null").select(*[F.sum(F.col("totals")[k]) for k in range(4)]).first()
    n, v, kept_n, kept_v = (int(x or 0) for x in totals)
    answers = spark.read.parquet(*answered).where("block is not null")
    n_blocks = n_tokens // BLOCK + 1
    shares = min(SHARES, 1 + n_blocks // 8)
    # a block's number is its task's in the upper half and counts up from 0 below
    of_share = lambda df, k: df.where(F.pmod(F.shiftright("block", 32) + F.col("block"), F.lit(shares)) == k)
    annotated = [write_scratch(_annotate(of_share(blocks, k), of_share(answers, k), bits, n_train - n_tune, (kept_n, kept_v), kind, n_blocks // shares + 1), "lm-annotated") for k in range(shares)]
    for path in (encoded, *answered):
        drop(spark, path)
    found = spark.read.schema(f"doc_ids array<{kind}>, lengths array<int>, parts array<int>, counts array<binary>, cells array<long>, times array<long>").parquet(*annotated)
    # the number of cells is bounded by context buckets and half octaves, not by the corpus
    cells = found.select(F.explode(F.arrays_zip("cells", "times")).alias("c")).groupBy("c.cells").agg(F.sum("c.times").alias("n")).collect()
    mixture = Mixture(order, {r["cells"]: r["n"] for r in cells}, kept_n, kept_v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                lengths = np.array(r["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                counts = [unpack(c, int(lengths.sum())) for c in r["counts"]]
                sums = []
                for first, last in _slices(lengths):  # a block's estimates take much more room than its counts
                    at, here = slice(starts[first], starts[last - 1] + lengths[last - 1]), starts[first:last] - starts[first]
                    c = [x[at].astype(np.float64) for x in counts]
                    base = (c[0] + 0.5) / (n + 0.5 * (v + 1))
                    p = mixture(base, *estimates(c, here, n_train, n))
                    sums.append([np.add.reduceat(x, here) for x in ((c[0] > 0).astype(np.int64), np.log10(base), np.log10(p))])
                out = np.array(r["parts"]) & 4 > 0
                columns = [np.concatenate(x) for x in zip(*sums)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], batch.schema.field(0).type.value_type), pa.array(out), pa.array(lengths), *map(pa.array, columns)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = found.select("doc_ids", "lengths", "parts", "counts").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
