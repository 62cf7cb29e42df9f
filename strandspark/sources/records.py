"""Text records as a Python data source: a writer with a commit, a reader by byte ranges, and a stream.

``df.write.format("strand_records").mode("append").save(folder)`` takes (record string, ...) rows and makes files of
them. Tasks write below ``_pending-<job>``; only the commit of the whole job moves their files into the folder and then
writes ``_manifest/<job>.json``, which lists them with records and bytes. A job that fails deletes what is pending, and
readers see files that a manifest lists and no others, so nothing of it is ever read. With ``exclusive`` a folder that
has a manifest is an error; else jobs append, and ``mode("overwrite")`` drops earlier manifests and files once its own is written.

``spark.read.format("strand_runs")`` reads run records: a record begins at a line that starts with ``#`` and belongs
to the byte range in which it begins, so a file of any size is read in ranges of ``split_bytes``. Where these would be
more than ``RANGES`` tasks they get longer, up to 64 MB, and each range reads little beyond its own bytes. ``spark.readStream``
takes the same files, and files without manifest that still grow: an offset is a number of bytes for each file, up
to the last line that begins a record (with ``closed``: to the end), so a record that is being written is not cut.

Paths and URIs are those of ``pyarrow.fs``: local ones, ``file``, ``hdfs``, ``s3``, ``gs`` and ``abfss``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

RUNS = "read_id string, run_idx int, base string, shape double, scale double, dwell int"
SPLIT_BYTES, RANGES = 64 << 20, 256


def file_system(uri: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    if uri.startswith("s3a:"):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri.rstrip("/"))


def _names(system, folder: str, kind: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == (fs.FileType.File if kind == "file" else fs.FileType.Directory))


def manifests(uri: str) -> list[dict]:
    """What each committed job has written, oldest first."""
    system, folder = file_system(uri)
    out = []
    for name in _names(system, f"{folder}/_manifest", "file"):
        if name.endswith(".json"):
            with system.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: (m["number"], m["job"]))


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    size: int


class RecordWriter(DataSourceArrowWriter):
    """One file a task; see the module for what a commit does."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.ending, self.separator = options.get("ending", "txt"), options.get("separator", "\n").encode()
        if "record" not in schema.names:
            raise ValueError("records are written from a column named record")
        if options.get("exclusive", "false").lower() == "true" and manifests(self.uri):
            raise FileExistsError(f"{self.uri} has records already")
        # made here and not by tasks: after an abort a task that is still running finds no place to write to
        system, folder = file_system(self.uri)
        system.create_dir(f"{folder}/_pending-{self.job}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.uri)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{self.job}-{task.taskAttemptId()}.{self.ending}"
        pending = f"{folder}/_pending-{self.job}"
        records = size = 0
        with system.open_output_stream(f"{pending}/{name}") as f:
            for b in batches:
                for x in b.column(b.schema.get_field_index("record")):
                    if x.is_valid:
                        data = x.as_py().encode() + self.separator
                        f.write(data)
                        records, size = records + 1, size + len(data)
        return Written(name, records, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.uri)
        earlier = manifests(self.uri)
        kept = [m for m in messages if m is not None and m.records]
        for m in kept:
            system.move(f"{folder}/_pending-{self.job}/{m.name}", f"{folder}/{m.name}")
        number = 1 + max((x["number"] for x in earlier), default=0)
        told = {"number": number, "job": self.job, "files": [{"name": m.name, "records": m.records, "bytes": m.size} for m in kept]}
        system.create_dir(f"{folder}/_manifest", recursive=True)
        with system.open_output_stream(f"{folder}/_manifest/{self.job}.json.new") as f:
            f.write(json.dumps(told).encode())
        system.move(f"{folder}/_manifest/{self.job}.json.new", f"{folder}/_manifest/{self.job}.json")
        for x in earlier if self.overwrite else []:
            system.delete_file(f"{folder}/_manifest/{x['job']}.json")
            for f in x["files"]:
                system.delete_file(f"{folder}/{f['name']}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = file_system(self.uri)
        for turn in range(5):
            try:
                if f"{folder}/_pending-{self.job}" in _names(system, folder, "folder"):
                    system.delete_dir(f"{folder}/_pending-{self.job}")
                return
            except OSError:  # a task that is being stopped has just begun a file there
                if turn == 4:
                    raise
                time.sleep(0.2)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def record_starts(f, start: int, stop: int, block: int = 1 << 20) -> Iterator[int]:
    """Places in [start, stop) of lines that start with ``#``."""
    at = max(0, start - 1)
    f.seek(at)
    before = b"\n" if start == 0 else b""
    while at < stop:
        data = f.read(min(block, stop - at))
        if not data:
            return
        text, shift = before + data, at - len(before)
        k = text.find(b"\n#")
        while k >= 0:
            if start <= shift + k + 1 < stop:
                yield shift + k + 1
            k = text.find(b"\n#", k + 1)
        before = text[-1:]
        at += len(data)


def records_in(f, start: int, stop: int, size: int, block: int = 1 << 20) -> Iterator[tuple[str, list[str]]]:
    """(name, lines) of the records that begin in [start, stop) of a file of ``size`` bytes; the last one is read to its end."""
    first = next(record_starts(f, start, stop, block), None)
    if first is None:
        return
    f.seek(first)
    at, rest, name, lines, beyond = first, b"", None, [], 2048
    while True:
        if at < stop:
            data = f.read(min(block, stop - at))
        else:  # the end of the last record, likely a short way
            beyond = min(block, 2 * beyond)
            data = f.read(min(beyond, size - at))
        pieces = (rest + data).split(b"\n")
        begun = at - len(rest)
        at += len(data)
        rest = pieces.pop() if data else b""
        for x in pieces:
            if x.startswith(b"#"):
                if name is not None:
                    yield name, lines
                if begun >= stop:
                    return
                name, lines = x[2:].decode(), []
            elif x.strip():
                lines.append(x.decode())
            begun += len(x) + 1
        if not data:
            yield name, lines
            return


def run_rows(name: str, lines: list[str]) -> Iterator[tuple]:
    for k, line in enumerate(lines):
        base, shape, scale, dwell = line.split("\t")[:4]
        yield name, k, base, float(shape), float(scale), int(dwell)


def _batches(path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    system, name = file_system(path)
    kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32())
    names = [c.split()[0] for c in RUNS.split(", ")]
    with system.open_input_file(name) as f:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for read, lines in records_in(f, start, stop, f.size()):
            for x in run_rows(read, lines):
                held.append(x)
                if len(held) >= 8192:
                    yield out()
                    held = []
        if held:
            yield out()


def ranges(spans: list[tuple[str, int, int]], split: int) -> list[Range]:
    """Ranges of (path, start, stop): ``split`` bytes each, and more, up to SPLIT_BYTES, where that makes too many."""
    total = sum(stop - start for _, start, stop in spans)
    step = max(split, min(SPLIT_BYTES, total // RANGES))
    return [Range(p, k, min(k + step, stop)) for p, start, stop in spans for k in range(start, stop, step)]


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        return ranges([(p, 0, n) for p, n in sorted(committed(self.uri).items())], self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(partition.path, partition.start, partition.stop)


def committed(uri: str) -> dict[str, int]:
    """Bytes of each file of a folder: those that its manifests list, or all where it has none."""
    system, folder = file_system(uri)
    head = uri[: len(uri.rstrip("/")) - len(folder)] if uri.rstrip("/").endswith(folder) else ""
    found = {f"{head}{folder}/{f['name']}": f["bytes"] for m in manifests(uri) for f in m["files"]}
    if found:
        return found
    names = [n for n in _names(system, folder, "file") if not n.rsplit("/", 1)[-1].startswith(("_", "."))]
    return {f"{head}{n}": system.get_file_info(n).size for n in names}


class RunStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.closed = options.get("closed", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        listed = {f["name"] for m in manifests(self.uri) for f in m["files"]}
        ends = {}
        for path, size in committed(self.uri).items():
            if self.closed or path.rsplit("/", 1)[-1] in listed:
                ends[path] = size
                continue
            system, name = file_system(path)
            with system.open_input_file(name) as f:
                ends[path] = last_start(f, size)
        return {"files": ends}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([(p, start["files"].get(p, 0), stop) for p, stop in sorted(end["files"].items())], self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.path, partition.start, partition.stop)


def last_start(f, size: int, block: int = 1 << 20) -> int:
    """Where the last record of a growing file begins: what is before is whole."""
    stop = size
    while stop > 0:
        start = max(0, stop - block)
        found = list(record_starts(f, start, stop, block))
        if found:
            return found[-1]
        stop = start
    return 0


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_records"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, schema, overwrite)


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_runs"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> RunReader:
        return RunReader(self.options)

    def streamReader(self, schema) -> RunStreamReader:
        return RunStreamReader(self.options)


def register(spark) -> None:
    from strandspark.session import ship

    ship(spark)
    spark.dataSource.register(RecordSource)
    spark.dataSource.register(RunSource)
