"""WARC archives with a two-level capture index.

Writing: equal payloads find their response by digest, each task streams its records, one gzip member
each, into an archive of its own in the shared folder, and the table of captures that Spark commits
names only archives of tasks that finished, so a retried task leaves nothing wrong behind.

Index: captures are range-partitioned by (reversed-host URL key, id), sorted, and written as compressed
blocks of BLOCK_LINES lines; the end of an index file is a sparse directory with each block's first key.
One row a file, its first key and where its directory lies, is the upper level; there are FILES files at
most, so it is small and may be broadcast.

Lookup: keys sorted in a task bisect the files, then a file's directory, then read one block's range;
found captures are sorted by archive and offset before their records are read by range.

Defined results: a null payload is empty, a null URL has an empty key; rows that repeat an id are all
responses if the id is the smallest of its payload; ids may not be null (such rows are left out); a very
long payload is one record; columns other than the three named are not read, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.session import materialise, scratch_path, ship

LEAST_PAYLOAD = 100
BLOCK_LINES, SALT, FILES = 256, 16, 4_096
_DATE = "2000-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Host reversed and comma-joined, then ')' and the path: captures of a host and its parts sort together."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^[^@]*@|:\d*$", "")
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(bare, r"(?s)^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def classify(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, key, payload, digest, owner): owner is the smallest id of equal payloads, null for small ones."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.where("id is not null").select("id", F.col("_url").alias("url"), url_key(F.col("_url")).alias("key"), "payload", F.sha2("payload", 256).alias("digest"))
    large = F.octet_length("payload") >= LEAST_PAYLOAD
    many = rows.where(large).groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    # a payload that many captures share is met in SALT places
    spread = many.select(F.col("digest").alias("d"), "owner", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
    return rows.withColumn("salt", salt).join(spread, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left").drop("d", "s", "salt")


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + c.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A gzip member's WARC fields, HTTP fields and payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x), payload


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """One record for each row; returns the committed table of captures (key, id, archive, offset, length)."""
    kind = classified.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                if out is None:
                    where, path = fs.FileSystem.from_uri(folder)
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                offsets, lengths = [], []
                for id_, url, payload, digest, owner in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                    revisit = owner is not None and owner != id_
                    fields = [("WARC-Record-ID", f"<urn:capture:{id_}>"), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                    if url is not None:
                        fields.append(("WARC-Target-URI", " ".join(url.split())))
                    if revisit:
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:capture:{owner}>")]
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    record = _record("revisit" if revisit else "response", fields, http if revisit else http + payload)
                    out.write(record)
                    offsets.append(at)
                    lengths.append(len(record))
                    at += len(record)
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([name] * b.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows = classified.select("id", "url", "key", "payload", "digest", "owner")
    return materialise(rows.mapInArrow(run, f"key string, id {kind}, archive string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorted compressed blocks with a sparse directory behind them; a row for each index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.idx"
        lines: list[list] = []
        directory: list[list] = []
        out, at = None, 0

        def block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            out.write(data)
            at += len(data)
            lines.clear()

        for b in batches:
            if out is None and b.num_rows:
                where, path = fs.FileSystem.from_uri(folder)
                where.create_dir(path, recursive=True)
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            for line in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(list(line))
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
            out.close()
            row = [[directory[0][0]], [json.dumps(directory[0][:2])], [name], [at], [len(tail)]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1]), pa.array(row[2]), pa.array(row[3], pa.int64()), pa.array(row[4], pa.int64())], names=["first", "first_entry", "file", "offset", "length"])

    rows = captures.select("key", "id", "archive", "offset", "length")
    # Spark's own number of partitions up to FILES, so that the upper level stays small on any cluster; the files grow instead
    few = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= FILES
    dealt = (rows.repartitionByRange("key", "id") if few else rows.repartitionByRange(FILES, "key", "id")).sortWithinPartitions("key", "id")
    return materialise(dealt.mapInArrow(run, "first string, first_entry string, file string, offset long, length long"), "index-files")


class Index:
    """The upper level, and what a task has read below it."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.folder = folder
        self.files = sorted((json.loads(f[0]), f[1], f[2], f[3]) for f in files)
        self.firsts = [f[0] for f in self.files]
        self.opened: tuple = (None, None, None)
        self.block: tuple = (None, None)

    def _file(self, k: int):
        if self.opened[0] != k:
            where, path = fs.FileSystem.from_uri(self.folder)
            source = where.open_input_file(f"{path}/{self.files[k][1]}")
            directory = json.loads(zlib.decompress(source.read_at(self.files[k][3], self.files[k][2])))
            self.opened, self.block = (k, source, directory), (None, None)
        return self.opened[1:]

    def find(self, key: str, id_) -> list[tuple[str, int, int]]:
        """Archive, offset and length of all captures of (key, id)."""
        k = max(0, bisect_right(self.firsts, [key, id_]) - 1)
        out: list[tuple[str, int, int]] = []
        while self.files and 0 <= k:
            source, directory = self._file(k)
            starts = [e[:2] for e in directory] if self.block[0] is None else self.starts
            self.starts = starts
            n = max(0, bisect_right(starts, [key, id_]) - 1)
            back = False
            while n >= 0:
                if self.block[0] != (k, n):
                    data = source.read_at(directory[n][3], directory[n][2])
                    lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                    self.block = ((k, n), lines)
                lines = self.block[1]
                here = [tuple(x[2:]) for x in lines if x[0] == key and x[1] == id_]
                out += here
                # repeated captures may begin in the block, or the file, before
                back = bool(here) and lines[0][:2] == [key, id_]
                if not back:
                    break
                n -= 1
            if not back:
                break
            k -= 1
        return out


def look_up(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(id, archive, offset, length) of the captures of each distinct (key, id) of ``wanted``."""
    spark = wanted.sparkSession
    kind = wanted.schema["id"].dataType.simpleString()
    upper = files.select("first_entry", "file", "offset", "length").collect()  # FILES rows at most, by write_index
    shared = spark.sparkContext.broadcast([tuple(r) for r in upper])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shared.value)
        for b in batches:
            ids, found = [], []
            for key, id_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in index.find(key, id_):
                    ids.append(id_)
                    found.append(f)
            columns = [list(c) for c in zip(*found)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(1).type), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["id", "archive", "offset", "length"])

    dealt = wanted.select("key", "id").dropDuplicates().repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, f"id {kind}, archive string, offset long, length long")


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """Each capture's record, read by range: id, payload size and digest, type and what it refers to."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        where, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            rows = []
            for id_, archive, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if archive != opened:
                    opened, source = archive, where.open_input_file(f"{path}/{archive}")
                fields, http, payload = parse(source.read_at(length, offset))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"capture {id_}: the payload read back has another digest")
                to = fields["WARC-Refers-To"][len("<urn:capture:") : -1] if revisit else None
                rows.append((fields["WARC-Record-ID"][len("<urn:capture:") : -1], int(http["Content-Length"]), digest, fields["WARC-Type"], to))
            columns = [list(c) for c in zip(*rows)] or [[], [], [], [], []]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = found.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    rows = dealt.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.select(F.col("id").cast(kind).alias("id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC with an index, then look up and read every capture back."""
    spark: SparkSession = pages.sparkSession
    ship(spark)
    folder = scratch_path(spark, "warc")
    captures = write_archives(classify(pages, id_col, url_col, payload_col), folder)
    files = write_index(captures, f"{folder}/index")
    wanted = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_url")).where("id is not null").select("id", url_key(F.col("_url")).alias("key"))
    return read_records(look_up(wanted, files, f"{folder}/index"), folder).withColumnRenamed("id", id_col)
