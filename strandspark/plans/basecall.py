"""Whole queries: reads to basecalls, reads to run records, run records to sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.functions import quality
from strandspark.operators import chain, network, sequence, signal
from strandspark.session import ship


def prepare(samples: DataFrame, trim=(200, 10), segmentation=(100, 0.0), delta: float = 0.0) -> DataFrame:
    """Trimmed, normalised samples: by median and MAD, or differences over ``delta``."""
    live = signal.trim(samples, segmentation[0], segmentation[1], *trim)
    if delta:
        return signal.difference(signal.shift_scale(live, F.lit(0.0), F.lit(delta)))
    return signal.normalise(live)


def _chosen(model: str, wanted: set[str]) -> tuple[str, int]:
    if model not in network.MODELS:
        raise ValueError(f"model is one of {', '.join(network.MODELS)}, not {model!r}")
    name, n_base, _ = network.MODELS[model]
    if network.family(name) not in wanted:
        raise ValueError(f"{model} is a {network.family(name)} model")
    return name, n_base


def with_signal(reads: DataFrame, limit: int = 0) -> DataFrame:
    """(read_id, filename, signal) of samples (read_id, idx, value), of read arrays, or of files' reads (``raw``), without failed ones.

    ``limit`` counts what is begun, failed files too: files by name where rows have one, else reads. Where rows come from
    files, ``fast5.read_fast5``'s own limit opens no others.
    """
    if "filename" in reads.columns:
        reads = limit_reads(reads, limit, "filename")
    else:
        reads = limit_reads(reads, limit)
    if "value" in reads.columns:
        reads = signal.to_reads(reads)
    elif "raw" in reads.columns:
        reads = reads.where("error is null").withColumnRenamed("raw", "signal")
    name = F.col("filename") if "filename" in reads.columns else F.col("read_id").cast("string")
    return reads.select("read_id", name.alias("filename"), F.col("signal").cast("array<double>").alias("signal"))


def limit_reads(rows: DataFrame, limit: int, by: str = "read_id") -> DataFrame:
    """Rows of the first ``limit`` reads, or other names, whole; 0 or less: of all."""
    if limit <= 0:
        return rows
    # at most ``limit`` names: a caller's number, not the data's
    return rows.join(F.broadcast(rows.select(by).distinct().orderBy(by).limit(limit)), by, "left_semi")


def _prepared(x: np.ndarray, trim, segmentation, delta: float) -> tuple[int, int, np.ndarray]:
    start, end = signal.live_part(x, segmentation[0], segmentation[1], *trim)
    live = x[start:end]
    return start, end, np.append(np.diff(live / delta), 0.0)[: len(live)] if delta else signal.normalised(live)


def _decoded(reads: DataFrame, weights, name: str, n_base: int, temperature: float, viterbi_only: bool, options: dict, schema: str, each: Callable) -> DataFrame:
    """One Arrow stage over reads: trim, normalise, network and path, then ``each`` read's rows as columns.

    A read is all that a task needs, so nothing is shuffled; reads without a live part give no rows.
    """
    ship(reads.sparkSession)
    settings = {"trim": (200, 10), "segmentation": (100, 0.0), "delta": 0.0} | options
    t = {"flip_flop": chain.flip_flop, "run_length": chain.run_length}[network.family(name)](n_base)
    shared = reads.sparkSession.sparkContext.broadcast(weights)
    out = reads.select("read_id", "filename").limit(0).selectExpr("read_id", "filename", *[f"CAST(NULL AS {k}) AS {n}" for n, k in (c.split(" ", 1) for c in schema.split(", "))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, network.BATCH_READS) for whole in batches for k in range(0, whole.num_rows, network.BATCH_READS)):
            raw = [np.array(s or [], float) for s in b.column(2).to_pylist()]
            ready = [_prepared(x, **settings) for x in raw]
            for some in network.in_batches([x[2] for x in ready]):
                w, lengths = network.run_batch([ready[k][2] for k in some], name, shared.value, n_base, temperature)
                found = w if viterbi_only else chain.step_posteriors_batch(w, lengths, t, normalised=t.name == "flip_flop")
                score, path, step = chain.viterbi_batch(found, lengths, t)
                for i, k in enumerate(some):
                    n = int(lengths[i])
                    columns = each(found[i, :n], w[i, :n], float(score[i]), path[i, : n + 1], step[i, :n], len(raw[k]), *ready[k])
                    rows = len(next(iter(columns.values())))
                    head = [pa.array([b.column(c)[k].as_py()] * rows, b.schema.field(c).type) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*head, *(pa.array(v, kinds[c]) for c, v in columns.items())], names=["read_id", "filename", *columns])

    kinds = {f.name: f.type for f in reads.sparkSession.createDataFrame([], out).toArrow().schema}
    return reads.mapInArrow(run, out)


def basecall(reads: DataFrame, weights: list[dict[str, np.ndarray]], model: str = "r941_native", temperature: float = 1.0, viterbi_only: bool = False, reverse: bool = False, trace: bool = False, limit: int = 0, **preparing) -> DataFrame:
    """A row a read that has a live part, ready for ``format_calls``; with ``trace`` also its normalised signal and state shares.

    (read_id, filename, basecall, quality, score, nblock, sequence_length, nsample, trim_start, trim_end) of what ``with_signal`` takes;
    ``limit`` counts reads begun, failed ones too.
    """
    name, n_base = _chosen(model, {"flip_flop"})
    t = chain.flip_flop(n_base)

    def each(found, w, score, path, step, nsample, start, end, live):
        moved = np.flatnonzero(path[1:-1] != path[:-2]) + 1  # neither the first state nor the step into the last is emitted
        letters = "".join(quality.BASES[s % n_base] for s in path[moved])
        phreds = quality.phred_letters(np.exp(step[moved - 1]))
        text, marks = (letters[::-1], phreds[::-1]) if reverse else (letters, phreds)
        own = {"basecall": [text], "quality": [marks], "score": [score], "nblock": [len(w)], "sequence_length": [len(text)], "nsample": [nsample], "trim_start": [start], "trim_end": [end]}
        return own | ({"signal": [live.tolist()], "trace": [chain.trace(found, t).tolist()]} if trace else {})

    schema = "basecall string, quality string, score double, nblock long, sequence_length int, nsample long, trim_start long, trim_end long"
    schema += ", signal array<double>, trace array<array<int>>" if trace else ""
    return _decoded(with_signal(reads, limit), weights, name, n_base, temperature, viterbi_only, preparing, schema, each)


def basecall_runs(reads: DataFrame, weights: list[dict[str, np.ndarray]], model: str = "rle_r941_native", temperature: float = 1.0, viterbi_only: bool = False, limit: int = 0, **preparing) -> DataFrame:
    """(read_id, filename, run_idx, base, shape, scale, dwell): the runs of reads, as ``basecall`` takes them."""
    name, n_base = _chosen(model, {"run_length"})

    def each(found, w, score, path, step, nsample, start, end, live):
        states = path[1:]  # the state a read begins in is not emitted
        first = np.flatnonzero(states < n_base)
        at = states[first] % n_base
        dwell = np.diff(np.append(first, len(states)))
        return {"run_idx": np.arange(len(first)), "base": [quality.BASES[k] for k in at], "shape": w[first, at], "scale": w[first, at + n_base], "dwell": dwell}

    schema = "run_idx int, base string, shape double, scale double, dwell int"
    return _decoded(with_signal(reads, limit), weights, name, n_base, temperature, viterbi_only, preparing, schema, each)


def decode_runs(runs: DataFrame, **options) -> DataFrame:
    return sequence.decode_runs(runs, **options)
