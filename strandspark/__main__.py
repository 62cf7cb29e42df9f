"""Programs over Spark: ``python -m strandspark basecall|runs|decode|trace ...``.

``basecall`` and ``runs`` call reads in HDF5 files with a model's weights, a table that ``sources.tables.weights_table``
makes; ``decode`` turns run records into FASTA; ``trace`` gives a viewer's table of traces. Results are folders of records under one commit
(``--output``), or lines on standard output, which an ordered stream of partitions writes.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.operators import network
from strandspark.plans import basecall
from strandspark.sources import fast5, records, tables, text

#: Models that a program takes when none is named.
DEFAULT_MODELS = {"basecall": "r941_native", "runs": "rle_r941_native"}


def positive(kind):
    def parse(value: str):
        x = kind(value)
        if x <= 0:
            raise argparse.ArgumentTypeError(f"{value} isn't positive")
        return x

    return parse


def trim(value: str) -> tuple[int, int]:
    head, tail = text.parse_trim(value)
    if head < 0 or tail < 0:
        raise argparse.ArgumentTypeError("ends are cut by no fewer than 0 samples")
    return head, tail


def segmentation(value: str) -> tuple[int, float]:
    chunk, share = text.parse_segmentation(value)
    if chunk <= 0 or not 0 <= share <= 1:
        raise argparse.ArgumentTypeError("a chunk has samples, and a percentile is from 0 to 100")
    return chunk, share


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandspark")
    programs = parser.add_subparsers(dest="program", required=True)
    for name in ("basecall", "runs"):
        p = programs.add_parser(name, help="bases with qualities" if name == "basecall" else "run records")
        p.add_argument("files", nargs="*", help="files, patterns or folders")
        p.add_argument("-d", "--delta", type=positive(float), default=0.0, help="call differences of samples, over this factor")
        p.add_argument("-l", "--limit", type=int, default=0, help="files to begin at most; 0: all")
        p.add_argument("-m", "--model", default=DEFAULT_MODELS[name], help="a model's name, or help for a list")
        p.add_argument("-o", "--output", help="folder to write to")
        p.add_argument("-p", "--prefix", default="", help="what names of records begin with")
        p.add_argument("--temperature", type=positive(float), default=1.0, help="weights are divided by it")
        p.add_argument("-t", "--trim", type=trim, default=(200, 10), metavar="HEAD:TAIL", help="samples to cut from either end")
        p.add_argument("--segmentation", type=segmentation, default=(100, 0.0), metavar="CHUNK:PERCENT", help="chunks whose spread tells the live part")
        p.add_argument("-v", "--viterbi", action=argparse.BooleanOptionalAction, default=False, help="best path of the weights themselves, not of posteriors")
        p.add_argument("--fb", dest="viterbi", action="store_false", help="the same as --no-viterbi")
        p.add_argument("--uuid", action=argparse.BooleanOptionalAction, default=True, help="name records by read, not by file")
        p.add_argument("--weights", help="Parquet table of weights")
        if name == "basecall":
            p.add_argument("-f", "--format", choices=text.OUTPUT_FORMATS, default="fastq")
            p.add_argument("-r", "--reverse", action=argparse.BooleanOptionalAction, default=False, help="calls from the read's end to its beginning")
            p.add_argument("-T", "--trace", help="folder for traces, as Parquet")
            p.add_argument("--compression-level", type=int, default=1, help="of traces")
    p = programs.add_parser("decode", help="sequences of run records")
    p.add_argument("file")
    p.add_argument("--limit", type=positive(int))
    p.add_argument("--rlc", action=argparse.BooleanOptionalAction, default=False, help="a letter a run")
    p.add_argument("--scale", nargs=4, type=positive(float), default=(1.02, 1.04, 1.04, 1.02), metavar=("A", "C", "G", "T"))
    p.add_argument("--shape", nargs=4, type=positive(float), default=(1.0, 1.0, 1.0, 1.0), metavar=("A", "C", "G", "T"))
    p.add_argument("--width", type=positive(int), default=60)
    p.add_argument("-o", "--output")
    p = programs.add_parser("trace", help="points of traces: read, place, state, probability")
    p.add_argument("files", nargs="+")
    p.add_argument("--analysis", type=int, default=0)
    p.add_argument("-o", "--output", required=True)
    return parser


def give(rows: DataFrame, output: str | None, ending: str) -> None:
    """Records to a folder that has none yet or has some to append to, else to standard output, a partition at a time."""
    if output:
        records.register(rows.sparkSession)
        rows.select("record").write.format("strand_records").option("ending", ending).mode("append").save(output)
        return
    for r in rows.select("record").toLocalIterator():
        sys.stdout.write(r["record"] + "\n")


def call(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = args.files if len(args.files) > 1 else args.files[0]
    reads = fast5.calibrated(fast5.read_fast5(spark, paths, limit=args.limit))
    weights = tables.load_weights(spark.read.parquet(args.weights), args.model)
    options = {"trim": args.trim, "segmentation": args.segmentation, "delta": args.delta}
    if args.program == "runs":
        runs = basecall.basecall_runs(reads, weights, args.model, args.temperature, args.viterbi, **options)
        name = F.col("read_id") if args.uuid else F.col("filename")
        give(text.run_records(runs.withColumn("read_id", F.concat(F.lit(args.prefix), name))), args.output, "run")
        return
    calls = basecall.basecall(reads, weights, args.model, args.temperature, args.viterbi, args.reverse, bool(args.trace), **options)
    if args.trace:
        tables.write_traces(calls, args.trace, level=args.compression_level)
    give(text.format_calls(calls, args.format, args.prefix, args.uuid), args.output, args.format)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if getattr(args, "model", "") == "help":
        for m, (net, n_base, about) in network.MODELS.items():
            if (network.family(net) == "flip_flop") == (args.program == "basecall"):
                print(f"{m:>16} : {about}, {n_base} bases" + "  (default)" * (m == DEFAULT_MODELS[args.program]))
        return 0
    if args.program in DEFAULT_MODELS and not (args.files and args.weights):
        parser.error("files and --weights are needed")
    spark = spark or SparkSession.builder.appName(f"strandspark-{args.program}").getOrCreate()
    if args.program in DEFAULT_MODELS:
        call(spark, args)
    elif args.program == "decode":
        runs = text.read_runs(spark, args.file)
        runs = basecall.limit_reads(runs, args.limit) if args.limit else runs
        sequences = basecall.decode_runs(runs, expand=not args.rlc, scale_factors=args.scale, shape_factors=args.shape)
        give(text.wrapped_fasta(sequences, args.width), args.output, "fasta")
    else:
        traces = fast5.read_traces(spark, args.files if len(args.files) > 1 else args.files[0], args.analysis)
        tables.trace_points(traces.where("error is null")).write.mode("append").parquet(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
