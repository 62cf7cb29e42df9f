"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class keeps its own mean and covariance; covariances shrink towards the pooled one and towards a
multiple of the identity, so that a small class still has an invertible matrix. The score is the
posterior of class 1: the logistic function of the difference of the two Mahalanobis log-densities
plus the log prior ratio, computed with Cholesky factors that are taken once per fit.

Defined results: null and empty texts have all-zero statistics and are scored like any other; rows
with repeated ids are each scored; documents without a label, and labels without a document, are not
used in the fit; with fewer than two classes to learn from, every score is the share of class 1 (one
half with no label at all); a very long text is read whole; columns of any name are carried or ignored,
and only ``text`` enters a score; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.session import materialise, ship

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "exclamations", "digits", "distinct_words",
    "neighbour_repeats", "top_word", "sentence_ends", "log_lines", "line_words", "line_repeats", "other_letters", "unended_lines",
)
D = len(STATISTICS)
_UPPER, _SYMBOL, _SHOUT, _DIGIT, _STOP = (bytes(s, "ascii") for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|<>{}[]=+@~^\\/_`", "!?", "0123456789", ".,;:"))
_HIGH = bytes(range(128, 256))


def _angle(part: float, whole: float) -> float:
    """Variance-stabilised fraction."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w, k = len(raw), len(words), len(lines)
    if not w:
        return [0.0] * D
    drop = lambda chars: n - len(raw.translate(None, chars))
    solid = sum(map(len, words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    counts = Counter(words)
    return [
        math.log1p(n), math.log1p(w), math.log(solid / w), _angle(drop(_UPPER), solid), _angle(drop(_SYMBOL), solid),
        _angle(drop(_SHOUT), solid), _angle(drop(_DIGIT), solid), math.log((len(counts) + 1) / (w + 1)), _angle(repeats, w - 1),
        _angle(max(counts.values()), w), _angle(drop(_STOP), solid), math.log1p(k), math.log(w / k), _angle(k - len(set(lines)), k),
        _angle(drop(_HIGH), solid), _angle(sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines), k),
    ]


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors of the shrunk covariances, their log-determinants and the log prior ratio."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        log_density = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.logdet[c] for c in (0, 1)]
        z = np.clip(log_density[1] - log_density[0] + self.prior, -700, 700)
        return 1 / (1 + np.exp(-z))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.1, to_identity: float = 0.02) -> Discriminant | float:
    """From each class's count, sum and sum of outer products."""
    if set(sums) != {0, 1} or min(s[0] for s in sums.values()) < 2:
        n = sum(s[0] for s in sums.values())
        return sums[1][0] / n if 1 in sums and n else 0.5 if not n else 0.0
    mean = np.stack([sums[c][1] / sums[c][0] for c in (0, 1)])
    own = np.stack([sums[c][2] / sums[c][0] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    weight = np.array([sums[c][0] for c in (0, 1)])
    pooled = np.tensordot(weight / weight.sum(), own, 1)
    scale = np.diag(np.diag(pooled) + 1e-4)  # the identity, in each statistic's own unit
    cov = (1 - to_pooled - to_identity) * own + to_pooled * pooled + to_identity * scale
    factor = np.linalg.cholesky(cov)
    return Discriminant(mean, np.linalg.inv(factor), 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1), math.log(weight[1] / weight[0]))


def document_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``stats``, an array in the order of STATISTICS."""
    ship(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.drop(columns="_text").assign(stats=pd.Series([statistics(t) for t in p["_text"]], index=p.index, dtype=object))

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInPandas(run, f"{kept}, stats array<double>")


def learn(labelled: DataFrame) -> Discriminant | float:
    """Fit on rows (``label`` 0 or 1, ``stats``); only sums of D + D*D numbers a class reach the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for p in parts:
            for c, g in p.groupby("label"):
                x = np.stack(g["stats"].to_numpy())
                t = total.setdefault(int(c), [0.0, np.zeros(D), np.zeros((D, D))])
                t[0] += len(x)
                t[1] += x.sum(0)
                t[2] += x.T @ x
        for c, t in total.items():
            yield pd.DataFrame({"label": c, "at": np.arange(1 + D + D * D), "value": np.concatenate([[t[0]], t[1], t[2].ravel()])})

    parts = labelled.select("label", "stats").mapInPandas(run, "label int, at int, value double")
    flat: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        flat.setdefault(r["label"], np.zeros(1 + D + D * D))[r["at"]] = r["value"]
    return fit({c: (v[0], v[1 : 1 + D], v[1 + D :].reshape(D, D)) for c, v in flat.items()})


def apply(model: Discriminant | float, stats: DataFrame) -> DataFrame:
    """``stats`` with its array replaced by ``score``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = np.stack(p["stats"].to_numpy()) if len(p) else np.zeros((0, D))
            yield p.drop(columns="stats").assign(score=model.scores(x) if isinstance(model, Discriminant) else np.full(len(p), float(model)))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "stats")
    return stats.mapInPandas(run, f"{kept}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; ``labels`` (doc_id, label) of rows where ``learn_from(doc_id)`` holds are learned."""
    stats = materialise(document_statistics(docs, ["doc_id"]), "quality-stats")
    model = learn(stats.where(learn_from(F.col("doc_id"))).join(labels, "doc_id"))
    return apply(model, stats)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all their columns, that score at least ``threshold`` with all labels learned."""
    sample = document_statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), ["doc_id"])
    model = learn(sample.join(labels, "doc_id"))
    return filter_by(model, docs, threshold)


def filter_by(model: Discriminant | float, docs: DataFrame, threshold: float) -> DataFrame:
    """Documents the model keeps, in one pass over them and without a shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, D)
            kept = model.scores(x) >= threshold if isinstance(model, Discriminant) else np.full(len(x), model >= threshold)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
