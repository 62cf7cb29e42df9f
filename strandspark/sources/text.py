"""Text formats: run records, hex-float matrices, FASTA, FASTQ and SAM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT_FORMATS = ("fasta", "fastq", "sam")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, run_idx, base, shape, scale, dwell): a record begins at a line that starts with ``# `` and may cross file splits.

    An empty file is empty. Names that themselves begin with ``# `` need ``records``' reader by byte ranges.
    """
    records = spark.read.option("lineSep", "\n# ").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "^# ", ""), "\n")  # a file's first record has no line before it
    rows = records.select(F.trim(lines[0]).alias("read_id"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("run_idx", "line"))
    f = F.split("line", "\t")
    return rows.where(F.length(F.trim("line")) > 0).select(
        "read_id", "run_idx", f[0].alias("base"), f[1].cast("double").alias("shape"), f[2].cast("double").alias("scale"), f[3].cast("int").alias("dwell")
    )


def run_records(runs: DataFrame) -> DataFrame:
    """(read_id, record): a header and a line for each run, in order."""
    line = F.format_string("%s\t%.6f\t%.6f\t%d", "base", "shape", "scale", "dwell")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run_idx", line.alias("line")))), lambda p: p["line"])
    return runs.groupBy("read_id").agg(F.concat(F.lit("# "), F.first("read_id"), F.lit("\n"), F.array_join(ordered, "\n")).alias("record"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(name, nr, nc, data): whole files of a size line and ``nc`` lines of ``nr`` hex floats; ``data`` holds columns.

    A file whose element count differs from its size line has null data.
    """

    def decode(parts):
        for p in parts:
            rows = []
            for name, text in zip(p["path"], p["value"]):
                first, _, rest = text.partition("\n")
                nr, nc = map(int, first.split())
                data = [float.fromhex(x) for x in rest.split()]
                rows.append((name.rsplit("/", 1)[-1], nr, nc, [data[k * nr : (k + 1) * nr] for k in range(nc)] if len(data) == nr * nc else None))
            yield pd.DataFrame(rows, columns=["name", "nr", "nc", "data"])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.mapInPandas(decode, "name string, nr int, nc int, data array<array<double>>")


def matrix_records(matrices: DataFrame) -> DataFrame:
    """(name, record): the text that ``read_matrices`` reads."""

    def encode(data):
        return data.map(lambda m: "\n".join("\t".join(float(x).hex() for x in column) for column in m))

    text = F.pandas_udf(encode, "string")
    return matrices.select("name", F.concat(F.format_string("%d\t%d\n", "nr", "nc"), text("data"), F.lit("\n")).alias("record"))


def _name(prefix: str, by_uuid: bool) -> Column:
    """What a record is called: its file, or its uuid; rows without a file name have the uuid alone."""
    name = F.col("read_id") if by_uuid else F.coalesce("filename", "read_id")
    return F.concat(F.lit(prefix), name)


def _header(prefix: str, by_uuid: bool) -> Column:
    """Name and a JSON-like description, shared by FASTA and FASTQ."""
    per_base = F.when(F.col("sequence_length") > 0, F.format_string("%.6f", F.col("nblock") / F.col("sequence_length"))).otherwise("null")
    return F.concat(
        _name(prefix, by_uuid),
        F.format_string('  { "filename" : "%s", "uuid" : "%s", "normalised_score" : %.6f,  "nblock" : %d,  "sequence_length" : %d,  "blocks_per_base" : ', "filename", "read_id", F.when(F.col("nblock") > 0, -F.col("score") / F.col("nblock")).otherwise(F.lit(0.0)), "nblock", "sequence_length"),
        per_base,
        F.format_string(', "nsample" : %d, "trim" : [ %d, %d ] }', "nsample", "trim_start", "trim_end"),
    )


def fasta(calls: DataFrame, prefix: str = "", by_uuid: bool = True) -> DataFrame:
    return calls.select("read_id", F.concat(F.lit(">"), _header(prefix, by_uuid), F.lit("\n"), "basecall").alias("record"))


def fastq(calls: DataFrame, prefix: str = "", by_uuid: bool = True) -> DataFrame:
    return calls.select("read_id", F.concat(F.lit("@"), _header(prefix, by_uuid), F.lit("\n"), "basecall", F.lit("\n+\n"), F.coalesce("quality", F.lit(""))).alias("record"))


def sam(calls: DataFrame, prefix: str = "", by_uuid: bool = True) -> DataFrame:
    """One unaligned record a read; an empty sequence is a star."""
    text = lambda c: F.when(F.length(c) > 0, F.col(c)).otherwise("*")
    return calls.select("read_id", F.concat_ws("\t", _name(prefix, by_uuid), F.lit("4\t*\t0\t0\t*\t*\t0\t0"), text("basecall"), text("quality")).alias("record"))


def format_calls(calls: DataFrame, kind: str, prefix: str = "", by_uuid: bool = True) -> DataFrame:
    """(read_id, record); records are named by uuid (``read_id``) or, without ``by_uuid``, by ``filename``."""
    if kind not in OUTPUT_FORMATS:
        raise ValueError(f"format is one of {', '.join(OUTPUT_FORMATS)}, in lower case, not {kind!r}")
    return {"fasta": fasta, "fastq": fastq, "sam": sam}[kind](calls, prefix, by_uuid)


def wrapped_fasta(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(read_id, record) of (read_id, sequence), lines of ``width`` letters; empty sequences have no record."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.where(F.length("sequence") > 0).select("read_id", F.concat(F.lit(">"), "read_id", F.lit("\n"), lines).alias("record"))


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as text files, one partition each."""
    records.select("record").write.mode(mode).text(path)


def parse_trim(text: str) -> tuple[int, int]:
    """``head:tail``, or one number for both ends."""
    head, _, tail = text.partition(":")
    return int(head), int(tail or head)


def parse_segmentation(text: str) -> tuple[int, float]:
    """``chunk:percentage``; the percentage becomes a fraction."""
    chunk, _, percent = text.partition(":")
    return int(chunk), float(percent or 0) / 100

