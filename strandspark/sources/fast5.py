"""Raw reads in HDF5 files; HDF5 support is loaded only when a file is read.

``read_fast5`` and ``read_traces`` find files by Spark's own listing, on any store that Spark reads, and parse them in
tasks, many small files to one; HDF5 can't be split. A file that can't be read becomes a row with its ``error``, so
that one bad file doesn't end a job. ``spark.read.format("strand_fast5")`` gives the same rows of local files, a partition each.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandspark.functions.arrays import scale_to_pa
from strandspark.sources import files

READS = "read_id string, filename string, n long, digitisation float, offset float, range float, sample_rate float, raw array<float>, error string"


def expand(path: str) -> list[str]:
    """A file, a pattern, or a directory's ``*.fast5`` (not below it), sorted."""
    return sorted(glob.glob(os.path.join(path, "*.fast5") if os.path.isdir(path) else path))


def _attribute(group, name: str) -> float | None:
    return float(group.attrs[name]) if group is not None and name in group.attrs else None


def _reads(file, first_only: bool):
    """(calibration group, raw group) of a single-read file's reads or of a multi-read file's."""
    if "Raw" in file:
        for name in file["Raw/Reads"]:
            yield file.get("UniqueGlobalKey/channel_id"), file[f"Raw/Reads/{name}"]
            if first_only:
                return
    else:
        for name in file:
            if "Raw" in file[name]:
                yield file[name].get("channel_id"), file[f"{name}/Raw"]


def read_rows(file, first_only: bool):
    """(read_id, n, calibration, samples) of an open file's reads, as rows without file name and error."""
    for channel, raw in _reads(file, first_only):
        read_id = raw.attrs["read_id"]
        signal = raw["Signal"][()].astype("float32").tolist()
        scaling = [_attribute(channel, a) for a in ("digitisation", "offset", "range", "sampling_rate")]
        yield (read_id.decode() if isinstance(read_id, bytes) else str(read_id), len(signal), *scaling, signal)


class Fast5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_fast5"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return Fast5Reader(self.options)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Fast5Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.first_only = options["path"], options.get("first_only", "true").lower() == "true"

    def partitions(self) -> list[File]:
        return [File(p) for p in expand(self.path)] or [File("")]

    def read(self, partition: File):
        if not partition.path:
            return
        name = os.path.basename(partition.path)
        try:
            import h5py

            with h5py.File(partition.path, "r") as file:
                for read_id, *rest in read_rows(file, self.first_only):
                    yield (read_id, name, *rest, None)
        except Exception as e:  # a bad file is reported in its row
            yield (None, name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])


TRACES = "read_id string, filename string, signal array<float>, trace array<array<int>>, error string"


def layout(file) -> str:
    """``single`` or ``multi`` read files by their version mark, else a file of traces."""
    return ("single" if "Raw" in file else "multi") if "file_version" in file.attrs else "traces"


def read_traces_of(file, name: str, analysis: int = 0):
    """(read, signal, trace, error) for each read: our own traces are 255ths, a basecaller's table is taken as it is, with the part of the signal it covers."""
    kind = layout(file)
    for read in [name] if kind == "single" else list(file):
        try:
            if kind == "traces":
                yield read, file[f"{read}/signal"][()], file[f"{read}/trace"][()], None
                continue
            group = file if kind == "single" else file[read]
            raw = f"Raw/Reads/{next(iter(group['Raw/Reads']))}/Signal" if kind == "single" else "Raw/Signal"
            trace = group[f"Analyses/Basecall_1D_{analysis:03d}/BaseCalled_template/Trace"][()]
            span = group[f"Analyses/Segmentation_{analysis:03d}/Summary/segmentation"].attrs
            start = int(span["first_sample_template"])
            yield read, group[raw][()][start : start + int(span["duration_template"])], trace, None
        except KeyError as e:
            yield read, None, None, f"KeyError: {e}"[:500]


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_trace"

    def schema(self) -> str:
        return TRACES

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(self.options)


class TraceReader(Fast5Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.analysis = int(options.get("analysis", "0"))

    def read(self, partition: File):
        if not partition.path:
            return
        name = os.path.basename(partition.path)
        try:
            import h5py

            with h5py.File(partition.path, "r") as file:
                for read, signal, trace, error in read_traces_of(file, name, self.analysis):
                    yield (read, name, None if error else signal.astype("float32").tolist(), None if error else trace.astype("int32").tolist(), error)
        except Exception as e:  # a bad file is reported in its row
            yield (None, name, None, None, f"{type(e).__name__}: {e}"[:500])


def _pattern(path: str | list[str]) -> str | None:
    """Folders are searched for this; files' own names or patterns stand for themselves."""
    last = [p.rstrip("/").rsplit("/", 1)[-1] for p in ([path] if isinstance(path, str) else path)]
    return None if all("*" in x or x.endswith(".fast5") for x in last) else "*.fast5"


def read_traces(spark: SparkSession, path: str | list[str], analysis: int = 0) -> DataFrame:
    """Traces in HDF5 files, our own or a basecaller's in single or multi read files."""

    def parse(name, f):
        import h5py

        with h5py.File(f, "r") as file:
            for read, signal, trace, error in read_traces_of(file, name, analysis):
                yield read, None if error else signal.astype("float32").tolist(), None if error else trace.astype("int32").tolist(), error

    found = files.read_files(spark, path, parse, "read_id string, signal array<float>, trace array<array<int>>, problem string", _pattern(path))
    return found.select("read_id", "filename", "signal", "trace", F.coalesce("error", "problem").alias("error"))


def read_fast5(spark: SparkSession, path: str | list[str], first_only: bool = True, limit: int = 0) -> DataFrame:
    """A row a read; ``limit`` counts files that are begun, by name, failed ones too."""

    def parse(name, f):
        import h5py

        with h5py.File(f, "r") as file:
            yield from read_rows(file, first_only)

    schema = "read_id string, n long, digitisation float, offset float, range float, sample_rate float, raw array<float>"
    found = files.read_files(spark, path, parse, schema, _pattern(path), limit=limit)
    return found.select(*[c.split()[0] for c in READS.split(", ")])


def calibrated(reads: DataFrame) -> DataFrame:
    """Raw samples in picoamperes; rows without calibration get an error."""
    known = F.col("offset").isNotNull() & F.col("range").isNotNull() & F.col("digitisation").isNotNull()
    return reads.withColumn("raw", F.when(known, scale_to_pa(F.col("raw"), F.col("offset"), F.col("range"), F.col("digitisation"))).otherwise(F.col("raw").cast("array<double>"))).withColumn(
        "error", F.coalesce("error", F.when(~known, "no_calibration"))
    )
