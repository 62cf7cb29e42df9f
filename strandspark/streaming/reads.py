"""Streams of signal and of blocks: state by read that grows by what arrives.

Chunks (read_id, seq, last, values) come in any order and are put together into reads; blocks (read_id, blk, last, w)
come in any order and are folded forward as far as they have come, so that of a read only the log sums of its states
and what waits behind a gap is held. A batch appends its rows to a list and never rewrites those that are there; a read's list is read
back when as many rows as its last one says have come, and rows that make a read whole are not written at all. State is dropped with the read, or ``ttl_ms`` after a list's last
change where that is given.

Defined results: a repeated chunk or block counts once, the first to come; a read whose last row never comes stays in
state, unless a waiting time makes it go out incomplete; null ids are a read of their own; an empty chunk adds nothing.
State lives in RocksDB, which ``state_in_rocksdb`` selects for streams that the session starts afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandspark.operators.chain import Topology, _lse
from strandspark.session import ship

ASSEMBLED = "read_id string, signal array<double>, complete boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _joined(found: dict[int, list[float]]) -> list[float]:
    return [v for k in sorted(found) for v in found[k]]


class ReadAssembler(StatefulProcessor):
    """One read's chunks: a list of them, and how many there are."""

    def __init__(self, wait_ms: int | None = None, ttl_ms: int | None = None):
        self.wait_ms, self.ttl_ms = wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq int, samples array<double>", self.ttl_ms)
        self.seen = handle.getValueState("seen", "held int, last int", self.ttl_ms)

    def _whole(self) -> dict[int, list[float]]:
        found: dict[int, list[float]] = {}
        for seq, samples in self.chunks.get():
            found.setdefault(int(seq), list(samples))
        return found

    def _drop(self) -> None:
        self.chunks.clear()
        self.seen.clear()
        for at in list(self.handle.listTimers()) if self.wait_ms is not None else []:
            self.handle.deleteTimer(at)

    def _take(self, came: list[tuple], timerValues) -> list[float] | None:
        """The read's samples, if it is whole with the chunks (seq, last, values) that came; else they are held."""
        held, last = self.seen.get() if self.seen.exists() else (0, -1)
        new = [(int(s), [float(v) for v in x] if x is not None else []) for s, _, x in came]
        last = max([last, *(int(s) for s, end, _ in came if end)])
        n = held + len(new)
        if last >= 0 and n > last:  # enough rows, if none came twice
            found = self._whole() if held else {}
            for s, samples in new:
                found.setdefault(s, samples)
            if all(k in found for k in range(last + 1)):
                if held:
                    self._drop()
                return _joined(found)
            self.chunks.put(list(found.items()))
            n = len(found)
        else:
            self.chunks.appendList(new)
        self.seen.update((n, last))
        if self.wait_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        return None

    def _expire(self) -> list[float] | None:
        if not self.seen.exists():
            return None
        samples = _joined(self._whole())
        self._drop()
        return samples

    def _out(self, key: tuple, samples: list[float] | None, complete: bool) -> list:
        return [pd.DataFrame({"read_id": [key[0]], "signal": [samples], "complete": [complete]})] if samples is not None else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [c for p in rows for c in zip(p["seq"], p["last"], p["values"])]
        yield from self._out(key, self._take(came, timerValues), True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key, self._expire(), False)

    def close(self) -> None:
        pass


class RowAssembler(ReadAssembler):
    """The same over rows: a read has few chunks in a batch, and a frame for each read costs more than they do."""

    def _out(self, key: tuple, samples: list[float] | None, complete: bool) -> list:
        return [Row(read_id=key[0], signal=samples, complete=complete)] if samples is not None else []

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(p["seq"], p["last"], p["values"]) for p in rows]
        yield from self._out(key, self._take(came, timerValues), True)


def assemble_reads(chunks: DataFrame, wait_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(read_id, signal, complete) of streamed chunks (read_id, seq, last, values).

    With ``wait_ms`` a read that gets no chunk for so long goes out incomplete. Spark then starts batches
    for as long as the query runs, so an ``availableNow`` trigger, which ends when nothing is left, needs None.
    """
    ship(chunks.sparkSession)
    state_in_rocksdb(chunks.sparkSession)
    mode = "None" if wait_ms is None and ttl_ms is None else "ProcessingTime"
    return chunks.groupBy("read_id").transformWithState(RowAssembler(wait_ms, ttl_ms), ASSEMBLED, "append", mode)


class ForwardFold(StatefulProcessor):
    """One read's forward log sums: (next block, last block, sums), and the blocks that wait behind a gap."""

    def __init__(self, t: Topology):
        self.t = t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, last long, f array<double>")
        self.waiting = handle.getListState("waiting", "blk long, w array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, last, f = self.at.get() if self.at.exists() else (0, -1, [0.0] * self.t.n_state)
        f = np.array(f, float)
        src, row, real = self.t.tables()
        came: dict[int, np.ndarray] = {}
        waited = self.waiting.exists()
        if waited:
            came = {int(b): w for b, w in self.waiting.get()}
        for p in rows:
            for b, end, w in zip(p["blk"], p["last"], p["w"]):
                if b >= now:
                    came.setdefault(int(b), w)
                last = int(b) if end else last
        while now in came:
            w = np.array(came.pop(now), float)
            f = _lse(np.where(real, f[src] + w[row], -np.inf), 1)
            now += 1
        if 0 <= last < now:
            self.at.clear()
            self.waiting.clear()
            yield pd.DataFrame({"read_id": [key[0]], "log_z": [float(_lse(f, 0))]})
            return
        self.at.update((now, last, f.tolist()))
        if came:
            self.waiting.put([(b, [float(v) for v in w]) for b, w in sorted(came.items())])
        elif waited:
            self.waiting.clear()

    def close(self) -> None:
        pass


def stream_partitions(blocks: DataFrame, t: Topology) -> DataFrame:
    """(read_id, log_z) of streamed blocks (read_id, blk, last, w), as ``chain.log_partitions`` has it for whole reads."""
    ship(blocks.sparkSession)
    state_in_rocksdb(blocks.sparkSession)
    kind = blocks.schema["read_id"].dataType.simpleString()
    return blocks.groupBy("read_id").transformWithStateInPandas(ForwardFold(t), f"read_id {kind}, log_z double", "append", "None")
