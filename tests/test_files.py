"""HDF5 readers against a stand-in for the file object, and layers taken over from training frameworks."""

import sys
import types

import numpy as np

from strandspark.operators import network
from strandspark.sources import fast5, tables


class Node(dict):
    """A group: names to groups or arrays, attributes, and paths with slashes."""

    def __init__(self, items=(), **attrs):
        super().__init__(items)
        self.attrs = attrs

    def __getitem__(self, path):
        first, _, rest = path.partition("/")
        found = super().__getitem__(first)
        return found[rest] if rest else found

    def get(self, path, default=None):
        try:
            return self[path]
        except KeyError:
            return default


class Data:
    def __init__(self, values, **attrs):
        self.values, self.attrs = np.array(values), attrs

    def __getitem__(self, key):
        return self.values


CHANNEL = {"digitisation": 8192.0, "offset": 16.0, "range": 1373.41, "sampling_rate": 4000.0}


def raw(read_id, values):
    return Node({"Signal": Data(values)}, read_id=read_id)


SINGLE = Node({"UniqueGlobalKey": Node({"channel_id": Node(**CHANNEL)}), "Raw": Node({"Reads": Node({"Read_1": raw(b"one", [1, 2, 3])})})}, file_version=1.0)
MULTI = Node({f"read_{k}": Node({"channel_id": Node(**CHANNEL), "Raw": raw(f"m{k}", [k, k + 1])}) for k in range(3)}, file_version=2.0)
CALLED = {
    "Analyses": Node({
        "Basecall_1D_000": Node({"BaseCalled_template": Node({"Trace": Data([[1, 2], [3, 4]])})}),
        "Segmentation_000": Node({"Summary": Node({"segmentation": Node(first_sample_template=1, duration_template=2)})}),
    })
}
FILES = {"a.fast5": SINGLE, "b.fast5": MULTI, "c.fast5": Node({"called": Node({"signal": Data([0.5, 1.5]), "trace": Data([[255, 0]])}), "cut": Node({"signal": Data([1.0])})})}


class Opened:
    def __init__(self, path, mode):
        name = path.rsplit("/", 1)[-1]
        if name not in FILES:
            raise OSError(f"no HDF5 file: {name}")
        self.file = FILES[name]

    def __enter__(self):
        return self.file

    def __exit__(self, *_):
        return False


def rows(monkeypatch, reader, name):
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=Opened))
    return list(reader.read(fast5.File(f"/data/{name}")))


def test_reads_of_single_and_multi_read_files(monkeypatch):
    reader = fast5.Fast5Reader({"path": "/data", "first_only": "false"})
    assert rows(monkeypatch, reader, "a.fast5") == [("one", "a.fast5", 3, 8192.0, 16.0, 1373.41, 4000.0, [1.0, 2.0, 3.0], None)]
    found = rows(monkeypatch, reader, "b.fast5")
    assert [(r[0], r[2], r[7]) for r in found] == [("m0", 2, [0.0, 1.0]), ("m1", 2, [1.0, 2.0]), ("m2", 2, [2.0, 3.0])]
    bad = rows(monkeypatch, reader, "z.fast5")
    assert len(bad) == 1 and bad[0][-1] == "OSError: no HDF5 file: z.fast5"


def test_traces_by_layout(monkeypatch):
    reader = fast5.TraceReader({"path": "/data"})
    assert [fast5.layout(f) for f in (SINGLE, MULTI, FILES["c.fast5"])] == ["single", "multi", "traces"]
    own = rows(monkeypatch, reader, "c.fast5")
    assert own[0] == ("called", "c.fast5", [0.5, 1.5], [[255, 0]], None) and own[1][2] is None and own[1][4].startswith("KeyError")
    assert rows(monkeypatch, reader, "a.fast5")[0][4].startswith("KeyError")
    single = Node({**SINGLE, **CALLED}, file_version=1.0)
    multi = Node({"r": Node({**CALLED, "Raw": raw("r", [5, 6, 7, 8])})}, file_version=2.0)
    assert [x.tolist() for x in next(fast5.read_traces_of(single, "a"))[1:3]] == [[2, 3], [[1, 2], [3, 4]]]
    assert [x.tolist() for x in next(fast5.read_traces_of(multi, "b"))[1:3]] == [[6, 7], [[1, 2], [3, 4]]]


def test_layers_from_training_frameworks():
    rng = np.random.default_rng(0)
    x, size = rng.normal(0, 1, (6, 3)), 4
    sig = lambda v: 1 / (1 + np.exp(-v))
    wi, wh, b = rng.normal(0, 1, (3 * size, 3)), rng.normal(0, 1, (3 * size, size)), rng.normal(0, 1, 3 * size)
    h, want = np.zeros(size), []
    for row in x:
        gi, gh = wi @ row + b, wh @ h
        r, z = sig(gi[:size] + gh[:size]), sig(gi[size : 2 * size] + gh[size : 2 * size])
        h = (1 - z) * np.tanh(gi[2 * size :] + r * gh[2 * size :]) + z * h
        want.append(h)
    p = tables.recurrent_layer(wi, wh, b, "gru_mod")
    assert np.allclose(network.gru(network.affine(x, p["w"], p["b"]), p["s"]), want)
    assert tables.recurrent_layer(wi, wh, b, "gru")["s2"].shape == (size, size)
    wi, wh, b = rng.normal(0, 1, (4 * size, 3)), rng.normal(0, 1, (4 * size, size)), rng.normal(0, 1, 4 * size)
    h, c, want = np.zeros(size), np.zeros(size), []
    for row in x:
        i, f, g, o = np.split(wi @ row + b + wh @ h, 4)
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
        want.append(h)
    p = tables.recurrent_layer(wi, wh, b, "lstm")
    assert np.allclose(network.lstm(network.affine(x, p["w"], p["b"]), p["s"]), want)
    filters, bias = rng.normal(0, 1, (5, 3, 3)), rng.normal(0, 1, 5)
    p = tables.convolution_layer(filters, bias, 2.0)
    padded = np.pad(x, ((1, 1), (0, 0)))
    assert np.allclose(network.convolution(x, p["w"], p["b"], 1), [[2 * sum(filters[o, f, k] * padded[j + k, f] for f in range(3) for k in range(3)) + bias[o] for o in range(5)] for j in range(6)])
    assert tables.linear_layer(np.ones((2, 3)), np.zeros(2))["w"].shape == (3, 2)


def test_traces_written_with_other_compression(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0], [[1, 2]])], "read_id string, signal array<double>, trace array<array<int>>")
    tables.write_traces(rows, str(tmp_path / "t"), compression="gzip", level=9)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
