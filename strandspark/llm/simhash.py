"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index.

Fingerprints at ``distance`` or fewer differing bits agree on at least one of ``distance + 1`` blocks
of bits. Rows meet by (block, its value); a group beyond GROUP rows is dealt out again by blocks of
its remaining bits, which loses no link and ends because few fingerprints share many bits. Inside a
bucket fingerprints are sorted by Gray rank, agreeing bits with their values are factored into nodes,
nodes into upper nodes, and pairs of nodes are descended together: each level adds the differences of
the bits that its nodes newly agree on, and a pair of whole groups is left once they exceed the limit.
A bucket returns a spanning forest of its links, never the pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; rows with
repeated ids are fingerprinted each; a component is named by its smallest id, nulls aside; a very long
text is fingerprinted whole; other columns may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import free_name, join_counted
from strandspark.llm.components import connected_components
from strandspark.session import materialise, ship

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Rows of a bucket, rows of one (block, value) group before it is dealt out again, children of a node, pairs of
#: nodes descended at a time.
BUCKET, GROUP, FAN, PAIRS = 16_000, 8_192, 8, 4_096
FULL = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], ">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp): a hash of the text, and its fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "th", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, f"id {kind}, th long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a with b; each label is a smallest member's index, as far as is known."""
    while True:
        la, lb = label[a], label[b]
        if not (differ := la != lb).any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label = up


def index_links(fps: np.ndarray, masks: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For distinct rows (fingerprint, mask it was dealt by): each row's smallest linked row's index, links followed.

    Rows stand in the order in which they come; ``fps`` may repeat under other masks.
    """
    n = len(fps)
    order = np.lexsort((gray_rank(fps & ~masks), gray_rank(fps & masks), masks))
    values, agree = [fps[order]], [np.full(n, np.uint64(FULL))]
    while len(values[-1]) > FAN:
        v, a = values[-1], agree[-1]
        cut = np.arange(0, len(v), FAN)
        ones, noughts = np.bitwise_and.reduceat(v & a, cut), np.bitwise_and.reduceat(~v & a, cut)
        values.append(ones)
        agree.append(ones | noughts)
    label = np.arange(n)
    top = len(values) - 1
    i, j = np.triu_indices(len(values[top]))
    shared = agree[top][i] & agree[top][j]
    acc = np.bitwise_count((values[top][i] ^ values[top][j]) & shared).astype(np.int64)
    down = np.arange(FAN)
    stack = [(top, i, j, shared, acc)]
    while stack:
        level, i, j, seen, acc = stack.pop()
        on = acc <= distance
        i, j, seen, acc = i[on], j[on], seen[on], acc[on]
        if level == 0:
            label = _merge_labels(label, i[i != j], j[i != j])
            continue
        if len(i) > PAIRS:  # the rest waits: what is held stays small however many pairs are left
            stack.append((level, i[PAIRS:], j[PAIRS:], seen[PAIRS:], acc[PAIRS:]))
            i, j, seen, acc = i[:PAIRS], j[:PAIRS], seen[:PAIRS], acc[:PAIRS]
        if not len(i):
            continue
        below = len(values[level - 1])
        ci, cj = (np.repeat(i * FAN, FAN * FAN).reshape(-1, FAN, FAN) + down[:, None]).ravel(), (np.repeat(j * FAN, FAN * FAN).reshape(-1, FAN, FAN) + down).ravel()
        real = np.flatnonzero((ci < below) & (cj < below) & (ci <= cj))
        ci, cj, parent = ci[real], cj[real], real // (FAN * FAN)
        both = agree[level - 1][ci] & agree[level - 1][cj]
        acc = acc[parent] + np.bitwise_count((values[level - 1][ci] ^ values[level - 1][cj]) & both & ~seen[parent])
        on = acc <= distance
        stack.append((level - 1, ci[on], cj[on], both[on], acc[on]))
    first = np.full(n, n)
    np.minimum.at(first, label, order)
    out = np.empty(n, np.int64)
    out[order] = first[label]
    return out


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of nearly equal runs of the given bit positions."""
    cut = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [m for a, b in zip(cut, cut[1:]) if (m := sum(1 << x for x in bits[a:b]))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(distinct: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Rows (fp, mask): every two fingerprints within ``distance`` share some (mask, fp & mask), and no such group is large."""
    spark = distinct.sparkSession
    masks, out = _blocks(list(range(64)), distance + 1), []
    level = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        key = (F.col("mask"), F.col("fp").bitwiseAND(F.col("mask")))
        large = level.groupBy(key[0].alias("mask"), key[1].alias("key")).count().where(F.col("count") > group).select("mask", "key")
        large = materialise(large, "large-groups")
        masks = [m for m in masks if 64 - m.bit_count() > max(1, group.bit_length() - 1)]
        if not masks or large.isEmpty():
            return _union([*out, level])
        level = level.withColumn("key", key[1])
        out.append(level.join(large, ["mask", "key"], "left_anti").select("fp", "mask"))
        finer = [(_signed(m), _signed(m | p)) for m in masks for p in _blocks([b for b in range(64) if not m >> b & 1], distance + 1)]
        # fixed, tiny table: at most 3 new masks for each of at most 3 ** depth old ones
        table = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))
        level = level.join(large, ["mask", "key"], "left_semi").join(table, "mask").select("fp", F.col("finer").alias("mask"))
        masks = [m | p for m in masks for p in _blocks([b for b in range(64) if not m >> b & 1], distance + 1)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all those within ``distance``."""
    rows = dealt(distinct, distance, group)
    n = max(1, -(-distinct.count() * (distance + 1) // bucket))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy()
        to = index_links(fps.view(np.uint64), pdf["mask"].to_numpy().view(np.uint64), distance)
        linked = fps != fps[to]
        return pd.DataFrame({"a": fps[linked], "b": fps[to][linked]})

    where = F.pmod(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))), F.lit(n))
    return rows.groupBy(where.alias("bucket")).applyInPandas(run, "a long, b long")


def rooted_components(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle: int) -> DataFrame:
    """(id, th, fp, root, component_id): ``root`` tells components apart that repeated ids give the same name."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    nodes = connected_components(links(distinct.select("fp"), distance))
    rooted = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialise(rooted.join(named, "root").select("fp", "root", "component_id", "n"), "components-of-fingerprints")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    return join_counted(prints, by_print, "fp", "n", total)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``."""
    return rooted_components(docs, id_col, text_col, distance, shingle).select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, of each component: of those with its smallest id the one with the smallest hash of its text."""
    found = materialise(rooted_components(docs, id_col, text_col, DISTANCE, SHINGLE), "simhash-components")
    own = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = own.groupBy("root").agg(F.first("component_id").alias("id"), F.min("th").alias("th"))
    least, th, text_hash = (free_name(docs, x) for x in ("kept_id", "kept_hash", "text_hash"))
    kept = materialise(kept.select(F.col("id").alias(least), F.col("th").alias(th)), "simhash-kept")
    keyed = docs.withColumn(text_hash, F.xxhash64(F.col(text_col).cast("string")))
    out = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(least)) & (F.col(text_hash) == F.col(th)), "left_semi")
    if not own.groupBy("id", "th").count().where("count > 1").isEmpty():  # equal rows
        out = out.dropDuplicates([id_col, text_hash])
    return out.drop(text_hash)
