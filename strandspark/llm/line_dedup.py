"""Line dedup by pairwise alignment.

Documents become sequences of line hashes. From each line on, and up to each line, the shortest run of
lines with at least ``min_words`` words is a block; a block is rarer than its lines, and any passage of
that length that two documents share is made of such blocks. A block's hash leads from every later
document to its first holder: two documents overlap there. So a block in thousands of documents makes
thousands of pairs and not their square, and no pair that could delete a line is missed, whatever
documents its lines come from.

Each pair is aligned once, by patience diff over the blocks that the two share there, in the order of either document:
equal blocks at the beginning and end of a stretch match; between them blocks that occur once on either side (or, where
there are none, the rarest) are anchors, a longest chain of anchors that increases on both sides is kept, and the
stretches between anchors are aligned in the same way. The lines of matched blocks go from the later document, and a
matched block goes wherever that document repeats it. The alignment keeps order: of passages that two documents have in
opposite order only those of the chain go, and the others stay.

Only hashes, positions and word counts are compared; text is shuffled once, to meet its deletions. A
very common block is joined by broadcast (``join_counted`` bounds how many there are), so that no task
meets all its documents.

Defined results: lines are compared without surrounding white space; blank lines neither match nor
count and go only if nothing else is left; very long texts are read whole; a document is an (id, text), so repeated rows are one
document and keep the same lines; rows with a null id or text are left as they are; a smaller id is
earlier, and of texts with the same id the one with the smaller hash; an empty table gives an empty
table; added columns get underscores where their name is taken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import free_name, join_counted
from strandspark.session import materialise, ship

MIN_WORDS = 10


def blocks(counts: list[int], min_words: int) -> set[tuple[int, int]]:
    """(start, stop) of the shortest runs with ``min_words`` words that begin or end at each line."""
    found, stop, start, ahead, behind = set(), 0, 0, 0, 0
    for k, n in enumerate(counts):
        while ahead < min_words and stop < len(counts):
            ahead += counts[stop]
            stop += 1
        if ahead >= min_words:
            found.add((k, stop))
        ahead -= n
        behind += n
        while behind - counts[start] >= min_words:
            behind -= counts[start]
            start += 1
        if behind >= min_words:
            found.add((start, k + 1))
    return found


def line_blocks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, hash, start, lines): each block of each document; start counts lines that aren't blank, th hashes the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            row, hashes, starts, sizes = [], [], [], []
            for n, text in enumerate(b.column(2).cast(pa.binary())):
                lines = [x for line in text.as_py().split(b"\n") if (x := line.strip())]
                own = b"".join(map(xxh3_128_digest, lines))
                counts = [len(x.split()) for x in lines]
                for start, stop in sorted(blocks(counts, min_words)):
                    row.append(n)
                    hashes.append(xxh3_128_digest(own[16 * start : 16 * stop]))
                    starts.append(start)
                    sizes.append(stop - start)
            at = pa.array(row, pa.int32())
            columns = [b.column(0).take(at), b.column(1).take(at), pa.array(hashes, pa.binary()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "hash", "start", "lines"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {kind}, th long, hash binary, start int, lines int")


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs (sorted by the first) that increases in the second."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[k] = ends[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[pile], ends[pile] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchors(later: list[bytes], earlier: list[bytes]) -> list[tuple[int, int]]:
    """First places on both sides of the common blocks that occur least often (of those unique in both, if there are any), sorted."""
    nl, ne = Counter(later), Counter(earlier)
    times = {x: nl[x] * n for x, n in ne.items() if x in nl}
    least = min(times.values(), default=0)
    there: dict[bytes, int] = {}
    for k, x in enumerate(earlier):
        there.setdefault(x, k)
    found: dict[bytes, int] = {}
    for k, x in enumerate(later):
        if times.get(x) == least:
            found.setdefault(x, k)
    return [(k, there[x]) for x, k in found.items()]


def align(later: list[bytes], earlier: list[bytes]) -> list[tuple[int, int]]:
    """Patience diff: matched (place in later, place in earlier), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(later), 0, len(earlier))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and later[a] == earlier[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and later[b - 1] == earlier[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        i, j = a, c
        for x, y in _chain(anchors(later[a:b], earlier[c:d])) if a < b and c < d else []:
            out.append((a + x, c + y))
            todo.append((i, a + x, j, c + y))
            i, j = a + x + 1, c + y + 1
        if i > a:
            todo.append((i, b, j, d))
    return sorted(out)


def gone_lines(blocks: list[dict]) -> set[int]:
    """Lines to delete from a document: its ``blocks`` that have an earlier holder, one alignment for each such document."""
    pairs: dict[tuple, list[dict]] = {}
    for x in blocks:
        pairs.setdefault((x["owner"], x["owner_th"]), []).append(x)
    gone: set[int] = set()
    for shared in pairs.values():
        shared.sort(key=lambda x: (x["start"], x["lines"]))
        there = {x["hash"]: (x["owner_start"], x["lines"]) for x in shared}
        later, earlier = [x["hash"] for x in shared], sorted(there, key=there.__getitem__)
        matched = {later[i] for i, _ in align(later, earlier)}
        gone.update(k for x in shared if x["hash"] in matched for k in range(x["start"], x["start"] + x["lines"]))
    return gone


def shared_blocks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, blocks): for documents that have any, their blocks with the earlier document that holds each first."""
    ship(docs.sparkSession)
    held = materialise(line_blocks(docs, id_col, text_col, min_words), "line-blocks")
    first = F.min(F.struct("id", "th", "start")).alias("first")
    owners = held.groupBy("hash").agg(first, F.max(F.struct("id", "th")).alias("last"), F.count("*").alias("n")).where("struct(first.id, first.th) < last")
    owners = materialise(owners.select("hash", F.col("first.id").alias("owner"), F.col("first.th").alias("owner_th"), F.col("first.start").alias("owner_start"), "n"), "block-owners")
    total = owners.agg(F.sum("n")).first()[0] or 0
    found = join_counted(held, owners, "hash", "n", total)
    found = found.where("struct(owner, owner_th) < struct(id, th)").select("id", "th", F.struct("hash", "start", "lines", "owner", "owner_th", "owner_start").alias("block"))
    return found.groupBy("id", "th").agg(F.collect_set("block").alias("blocks"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages of whole lines deleted from later documents, and ``lines_removed``."""
    gone, th, removed = (free_name(docs, x) for x in ("gone_lines", "text_hash", "lines_removed"))
    found = shared_blocks(docs, id_col, text_col, min_words).toDF("gone_id", th, gone)
    keyed = docs.withColumn(th + "_own", F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(found, (F.col(id_col) == F.col("gone_id")) & (F.col(th + "_own") == F.col(th)), "left").select(*docs.columns, gone)
    text_at, gone_at = joined.columns.index(text_col), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            texts, numbers, blocks = b.column(text_at).to_pylist(), [0] * b.num_rows, b.column(gone_at)
            for k in np.flatnonzero(blocks.is_valid().to_numpy(zero_copy_only=False)).tolist():
                out = gone_lines(blocks[k].as_py())
                numbers[k] = len(out)
                kept, at = [], -1
                for x in texts[k].split("\n"):
                    at += (full := bool(x.encode("utf-8", "surrogatepass").strip()))
                    if not full or at not in out:
                        kept.append((x, full))
                texts[k] = "\n".join(x for x, _ in kept) if any(full for _, full in kept) else ""
            columns = list(b.columns)
            columns[text_at], columns[gone_at] = pa.array(texts, b.schema.field(text_at).type), pa.array(numbers, pa.int32())
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], removed])

    schema = docs.select("*").withColumn(removed, F.lit(0)).schema
    return joined.mapInArrow(run, schema)
