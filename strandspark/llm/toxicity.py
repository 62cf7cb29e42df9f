"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystrom landmarks.

The kernel of two strings sums, over subsequences of three letters, the products of their weights; an
occurrence weighs DECAY to the power of the stretch it covers, so letters put between those of an
insult only dampen it. Strings are units of sentences, scaled by the length-only norm of a string with
all letters different: words without the signs between their letters ("i.d-iot"), runs of single
characters ("i d i o t"), and two words that meet like the halves of a mark ("mo ron"). A unit begins with
a letter of its own for the word's beginning. Telling marks are looked for within units: their kernel is the
largest one of all the unit's windows of SHORT to LONG letters, at every letter and of every length, so
letters put before, behind or into an insult, and whatever it is glued to, don't hide it.

Labels belong to documents, so sentences are labelled first. Marks are letter sequences, stems or whole
words, that tell units of toxic documents from those of clean ones by the number of different words
behind which they stand (so copies of a document count once); they are picked one after another by
log-likelihood gain, each on the units that hold no better one, until it falls below LEAST_GAIN; their
share of toxic contexts is LIFT times that of all units. In a
toxic document's sentence the units that hold a mark are positive examples, and so are marks that clean
documents lack with one and with two letters put in at all places; every unit of a clean document's sentence
is a negative one. Such marks lose the letter of the word's beginning, unless clean units hold ones that
are ALIKE. Landmarks are the marks and frequent clean units. The POWER of a unit's kernels with the
landmarks, whitened by the landmarks' own (Nystrom), are the features of a linear machine with squared
hinge loss. A unit that is not within GATE of any mark counts as far from all of them; that is read from one
table of the largest weight that any mark gives a subsequence, which bounds all their kernels, so most units never meet the landmarks.

A text is toxic if one unit's margin is LEAST or more, or if its TOP largest margins together are, by a logistic
curve: one insult is enough, of words that clean texts use as well it takes several. LEAST is what SLIPS of the
sample's clean texts reach, or a plain mark's margin if that is less; the curve's one half lies where errors on the rest of the sample are least.

The fit uses a bounded sample: TRAIN_DOCS labelled documents of each class by hash order, of which copies
count once, the TRAIN_GRAMS best letter sequences with the TRAIN_UNITS most frequent units that hold
them, and TRAIN_UNITS clean units, half of them those nearest to the landmarks and half by hash order.
Every text is scored whole; words of more than COUNTED letters are scored, but not counted when marks are chosen.

Defined results: null and empty texts have the score of a text without units; an empty table gives an empty table; with no toxic or no clean
label to learn from, or no mark among them, every score is 0 or, with toxic labels only, 1. Labels, other
columns and ids never enter a score. Repeated rows are scored each, rows with a null id too; ties in gain
go to the longer sequence, then to the first in the alphabet.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.session import materialise, ship

DECAY, STRETCH, LETTERS, POWER, GATE, COST, ALIKE = 0.8, 9, 64, 3, 0.42, 10.0, 0.8
#: Share of clean documents of the sample that one unit may make toxic.
SLIPS = 0.01
TRAIN_DOCS, TRAIN_UNITS, TRAIN_GRAMS = 3_000, 40_000, 5_000
LANDMARKS, BACKGROUND, LEAST_GAIN, LIFT = 64, 16, 16.0, 3.0
GRAMS, TOP, BEGIN, COUNTED = (4, 5, 6, 7, 8), 6, "^", 40
RAMP, SHORT, LONG, CACHE = (0.4, 0.65), 4, 12, 400_000
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\w)")
_SIGNS = re.compile(r"[\W_]+")
_codes: list[np.ndarray] = []
_scores: dict = {}


def _letters() -> np.ndarray:
    """Code of each character below 0x3000: Latin letters 1 to 26, digits, then other letters by remainder, BEGIN; 0 is a gap."""
    if not _codes:
        code = np.zeros(0x3000, np.int64)
        for c in range(0x3000):
            x = chr(c)
            if "a" <= x <= "z":
                code[c] = 1 + c - 97
            elif "0" <= x <= "9":
                code[c] = 27 + c - 48
            elif x.isalpha():
                code[c] = 37 + c % 26
        code[ord(BEGIN)] = LETTERS - 1
        _codes.append(code)
    return _codes[0]


def units(text: str, halves: dict[str, int] | None = None) -> set[str]:
    """Letters and digits of each word of at least three, of spelled words and, by ``halves``, of two words that may be one cut in two."""
    words = text.lower().split()
    found = set(words)
    found.update(_SPELLED.findall(text.lower()))
    if halves:
        found.update(a + b for a, b in zip(words, words[1:]) if len(a) + len(b) <= halves.get(a[-2:] + b[:2], 0))
    return {x for w in found if len(x := w if w.isalnum() else _SIGNS.sub("", w)) >= 3}


def _halves(marks: list[str]) -> dict[str, int]:
    """What stands on both sides of a cut in a mark, two letters each at most, and how long both words may be."""
    out: dict[str, int] = {}
    for m in marks:
        for k in range(1, len(m)):
            key = m[max(0, k - 2) : k] + m[k : k + 2]
            out[key] = max(out.get(key, 0), len(m) + 2)
    return out


def _norms() -> np.ndarray:
    """By number of letters: the kernel norm of a string with all letters different."""
    spans = np.array([sum(1 for d in range(1, s - 1)) for s in range(STRETCH + 1)])
    out = np.ones(4 * LONG + 1)
    for m in range(3, len(out)):
        out[m] = math.sqrt(sum((m - s + 1) * spans[s] * DECAY ** (2 * s) for s in range(3, min(m, STRETCH) + 1)))
    return out


_GAPS = [(a, b, DECAY ** (a + b + 1)) for a in range(1, STRETCH - 1) for b in range(1, STRETCH - a)]


def _coded(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' codes with gaps between them, and each one's start."""
    gap = " " * LONG
    points = np.frombuffer((gap.join(pieces) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    code = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 37 + points % 26)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + LONG
    return code, np.cumsum(lengths) - lengths


def _against(pieces: list[str], weights: np.ndarray, within: int | None = None) -> np.ndarray:
    """Scaled kernel of each piece with what ``weights`` (subsequence table, one or more columns) stands for.

    For the first ``within`` columns (None: all) it is the largest one of the piece's windows of SHORT to LONG letters, for others that of the whole piece.
    """
    code, starts = _coded(pieces)
    n = len(code) - STRETCH
    spans = np.zeros((STRETCH - 2, n + 1, *weights.shape[1:]), np.float32)  # by stretch, from each place on
    for a, b, w in _GAPS:
        at = (code[:n] * LETTERS + code[a : n + a]) * LETTERS + code[a + b : n + a + b]
        spans[a + b - 2, :n] += np.float32(w) * weights[at]
    np.cumsum(spans, 0, out=spans)
    letters = np.concatenate([[0], np.cumsum(code > 0)])
    norms, place = _norms().astype(np.float32), np.arange(n)
    window, best = spans[0], np.zeros_like(spans[0, :n])
    for size in range(4, LONG + 1):
        # subsequences that begin at the window's first letter, and those of the window one shorter behind it
        longer = spans[min(size, STRETCH) - 3].copy()
        longer[:n] += window[1:]
        window = longer
        norm = norms[np.clip(letters[np.minimum(place + size, len(code))] - letters[place], SHORT, LONG)]
        best = np.maximum(best, window[:n] / (norm if weights.ndim == 1 else norm[:, None]))
    best[code[:n] == 0] = 0  # windows that begin in a gap reach into the next piece
    out = np.maximum.reduceat(best, np.minimum(starts, n - 1), axis=0)
    if within is not None:
        sizes = np.add.reduceat(code > 0, starts)
        whole = np.add.reduceat(spans[-1, :n, within:], np.minimum(starts, n - 1), axis=0)
        out[:, within:] = whole / (norms[np.clip(sizes, SHORT, len(norms) - 1)] * np.sqrt(np.maximum(1, sizes / (len(norms) - 1))))[:, None]
    return out


def _table(strings: list[str]) -> np.ndarray:
    """Subsequence weights of each string, scaled, one column each."""
    out = np.zeros((LETTERS**3, len(strings)), np.float32)
    for k, s in enumerate(strings):
        code, _ = _coded([s])
        norm = _norms()[np.clip((code > 0).sum(), SHORT, 4 * LONG)]
        for a, b, w in _GAPS:
            for i in range(len(s) - a - b):
                c = code[[i, i + a, i + a + b]]
                if c.all():
                    out[(c[0] * LETTERS + c[1]) * LETTERS + c[2], k] += w / norm
    return out


def _words(text: str) -> Iterator[tuple[str, str]]:
    """A text's words, each with BEGIN before it, and the word that comes before."""
    before = ""
    for w in text.lower().split():
        w = w if w.isalnum() else _SIGNS.sub("", w)
        if 3 <= len(w) <= COUNTED:
            yield BEGIN + w, before
        before = w


def _few(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents a hundred at a time, so that what is counted of them stays small."""
    return (p.iloc[k : k + 100] for p in parts for k in range(0, len(p), 100))


def unit_contexts(sample: DataFrame) -> DataFrame:
    """(unit, pos, neg): behind how many different words a unit stands in toxic and clean documents of ``sample`` (label, text).

    Words of chance in a document that has many near copies stand in all of them, but behind the same word.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _few(parts):
            found = {0: set(), 1: set()}
            for y, t in zip(p["label"], p["text"]):
                found[int(y)].update(_words(t or ""))
            both = list(found[0] | found[1])
            yield pd.DataFrame({"unit": pd.Series([u for u, _ in both], dtype=object), "before": pd.Series([w for _, w in both], dtype=object), "pos": [x in found[1] for x in both], "neg": [x in found[0] for x in both]})

    pairs = sample.select("label", "text").mapInPandas(run, "unit string, before string, pos boolean, neg boolean").where(F.length("unit") >= 3)
    pairs = pairs.groupBy("unit", "before").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return pairs.groupBy("unit").agg(F.count_if("pos").alias("pos"), F.count_if("neg").alias("neg"))


def _grams(unit: str) -> set[str]:
    """Letter sequences of a piece, and all of it."""
    return {unit, *(unit[i : i + n] for n in GRAMS for i in range(len(unit) - n + 1))}


def _gain(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood won by an own share of toxic contexts that is LIFT times ``share`` at least; 0 for a smaller one."""
    own = pos / np.maximum(pos + neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        won = np.where(pos > 0, pos * np.log(own / share), 0.0) + np.where(neg > 0, neg * np.log((1 - own) / (1 - share)), 0.0)
    return np.where((own >= min(LIFT * share, 0.9)) & (pos > 0), won, 0.0).round(6)


def choose_marks(contexts: DataFrame, most: int) -> pd.DataFrame:
    """(gram, pos, neg) of at most ``most`` marks in the order in which they are picked."""
    n = contexts.agg(F.sum("pos"), F.sum("neg")).first()
    if not n[0] or not n[1]:
        return pd.DataFrame({"gram": [], "pos": [], "neg": []})
    share = n[0] / (n[0] + n[1])

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (x for whole in parts for x in _chunks(whole, 2_000)):
            rows = [(g, a, b) for u, a, b in zip(p["unit"], p["pos"], p["neg"]) for g in _grams(u)]
            yield pd.DataFrame(rows, columns=["gram", "pos", "neg"]).groupby("gram", as_index=False).sum() if rows else pd.DataFrame({"gram": [], "pos": [], "neg": []})

    grams = contexts.mapInPandas(cut, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    own = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.col("pos") * F.ln(own / share) + F.when(F.col("neg") > 0, F.col("neg") * F.ln((1 - own) / (1 - share))).otherwise(0)
    likely = grams.where(own >= min(LIFT * share, 0.9)).withColumn("gain", F.round(gain, 6)).where(F.col("gain") >= LEAST_GAIN)
    names = [r["gram"] for r in likely.orderBy(F.desc("gain"), F.desc(F.length("gram")), "gram").limit(TRAIN_GRAMS).collect()]
    names.sort(key=lambda g: (-len(g), g))  # so that of equal gains the first is the longest
    place = {g: k for k, g in enumerate(names)}

    def hold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            held = [sorted({place[g] for g in _grams(u) if g in place}) for u in p["unit"]]
            yield p.assign(held=pd.Series(held, index=p.index, dtype=object))[[bool(h) for h in held]]

    units_ = contexts.mapInPandas(hold, "unit string, pos long, neg long, held array<int>").orderBy(F.desc("pos"), F.desc("neg"), "unit").limit(TRAIN_UNITS).toPandas()
    row = np.repeat(np.arange(len(units_)), [len(h) for h in units_["held"]]).astype(np.int64)
    gram = np.concatenate([*units_["held"], []]).astype(np.int64)
    pos, neg, left, chosen = units_["pos"].to_numpy(float), units_["neg"].to_numpy(float), np.ones(len(units_), bool), []
    while len(chosen) < most and len(gram):
        on = left[row]
        held = [np.bincount(gram[on], x[row[on]], minlength=len(names)) for x in (pos, neg)]
        won = _gain(*held, share)
        best = int(np.argmax(won))
        if won[best] < LEAST_GAIN:
            break
        chosen.append((names[best], held[0][best], held[1][best]))
        left[row[gram == best]] = False
    return pd.DataFrame(chosen, columns=["gram", "pos", "neg"])


def disguised(mark: str) -> list[str]:
    """The mark with one or two letters that it doesn't hold put in, at each place within."""
    one, two = [c for c in "xqzjkw" if c not in mark][:2]
    start = len(BEGIN) + 1 if mark.startswith(BEGIN) else 1
    return [mark[:k] + one + mark[k:] for k in range(start, len(mark))] + [mark[:k] + one + mark[k:j] + two + mark[j:] for k in range(start, len(mark)) for j in range(k, len(mark))]


def bare(marks: pd.DataFrame, counts: DataFrame) -> list[str]:
    """Marks without BEGIN where clean units hold next to nothing like the same letters, so that they are found in longer words."""
    stems = [g.removeprefix(BEGIN) for g in marks["gram"]]
    table = _table(stems)

    def alike(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (x for whole in parts for x in _chunks(whole, 500)):
            near = _against(p["unit"].tolist(), table) >= ALIKE
            yield pd.DataFrame({"stem": np.arange(len(stems)), "neg": (near * p["neg"].to_numpy()[:, None]).sum(0).astype(np.int64)})

    found = counts.where("neg > 0").select("unit", "neg").mapInPandas(alike, "stem int, neg long").groupBy("stem").agg(F.sum("neg").alias("neg")).collect()
    clean = {r["stem"]: r["neg"] for r in found}  # a row a mark at most
    return [x if len(x) >= 4 and clean.get(k, 0) <= 0.02 * a else g for k, (g, x, a) in enumerate(zip(marks["gram"], stems, marks["pos"]))]


def train_machine(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, cost: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; each row counts as pos and as three times neg examples."""
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(x)), -np.ones(len(x))])
    c = cost * np.concatenate([pos, neg])
    two = np.concatenate([x, x])
    ridge = np.eye(x.shape[1]) * 1.0
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        on = (y * (two @ w) < 1) & (c > 0)
        a = two[on]
        new = np.linalg.solve(ridge + (a * c[on, None]).T @ a, (a * c[on, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = 0.5 * (w + new)
    return new[:-1], float(new[-1])


def _gated(pieces: list[str], gate: np.ndarray) -> np.ndarray:
    """Which pieces may be near a mark; pieces of any length, LETTERS at a time so that what is held stays small."""
    sizes = np.cumsum([len(p) + LONG for p in pieces]) // 400_000
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(pieces)]
    return np.concatenate([_against(pieces[a:b], gate) >= GATE for a, b in zip(cuts, cuts[1:])])


@dataclass
class Machine:
    gate: np.ndarray  # subsequence table: each one's largest weight in a mark, so no piece is nearer to one than this tells
    table: np.ndarray  # of each landmark, a column each
    beta: np.ndarray
    bias: float
    within: int  # so many landmarks, the first ones, are looked for within words
    least: float = 0.0  # margin of a unit that is enough alone
    steep: float = 1.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(TOP))
    shift: float = -20.0
    key: str = ""
    halves: dict[str, int] | None = None

    def unit_margins(self, pieces: list[str]) -> np.ndarray:
        """A piece near to no mark has the bias; that is seen from one table, so most pieces never meet the landmarks."""
        out = np.full(len(pieces), self.bias)
        near = np.flatnonzero(_gated(pieces, self.gate)) if pieces else []
        for at in range(0, len(near), 500):
            some = near[at : at + 500]
            out[some] += _against([pieces[k] for k in some], self.table, self.within) ** POWER @ self.beta
        return out

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Each text's TOP largest unit margins; the bias alone where it has no more units."""
        if _scores.get("key") != self.key or len(_scores["known"]) > CACHE:
            _scores.update(key=self.key, known={})
        known = _scores["known"]
        found = [units(t, self.halves) if t else set() for t in texts]
        missing = list(set().union(*found).difference(known)) if found else []
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            known.update(zip(some, self.unit_margins([BEGIN + u for u in some]).tolist()))
        none = [self.bias] * TOP
        return np.array([nlargest(TOP, [*map(known.__getitem__, f), *none]) for f in found]).reshape(-1, TOP)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.margins(texts)
        return 1 / (1 + np.exp(-np.clip(np.maximum(self.steep * (m[:, 0] - self.least), evidence(m, self.bias) @ self.slope + self.shift), -500, 500)))


def evidence(margins: np.ndarray, bias: float) -> np.ndarray:
    """Columns from 0 to 1 for a logistic curve: how far each margin is from the bias to the machine's boundary."""
    return np.clip((1 + margins / max(-bias, 0.1) - RAMP[0]) / (RAMP[1] - RAMP[0]), 0, 1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> np.ndarray:
    """Slopes of a weighted, slightly regularised logistic curve; none is negative."""
    on = np.ones(x.shape[1] + 1, bool)
    a = np.hstack([x, np.ones((len(x), 1))])
    while True:
        t = np.zeros(len(on))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ t, -500, 500)))
            b = a[:, on]
            h = (b * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ b + 1e-3 * np.eye(on.sum())
            step = np.linalg.solve(h, b.T @ (w * (y - p)) - 1e-3 * t[on])
            t[on] += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        low = np.flatnonzero(t[:-1] < 0)
        if not len(low):
            return t[:-1]
        on[low] = False


def boundary(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Least weighted errors; within the interval that has them, nearer to the clean side, where gapped insults lie."""
    order = np.argsort(margin, kind="stable")
    m, up = margin[order], np.where(y[order] == 1, w[order], -w[order])
    cost = np.concatenate([[0.0], np.cumsum(up)])  # toxic ones below the cut, less the clean ones below it
    cut = np.concatenate([[True], m[1:] > m[:-1], [True]])
    best = int(np.flatnonzero(cut)[np.argmin(cost[cut])])
    low, high = (m[best - 1] if best else m[0] - 1), (m[best] if best < len(m) else m[-1] + 1)
    return float(low + 0.3 * (high - low))


def labelled_sentences(sample: DataFrame, marks: list[str]) -> DataFrame:
    """(unit, pos, neg): in how many sentences a unit decides on the label.

    Units that hold a mark do in each sentence of a toxic document, every unit does in each sentence of a clean one.
    """
    marked = re.compile("|".join(map(re.escape, marks)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _few(parts):
            count = {0: Counter(), 1: Counter()}
            for y, t in zip(p["label"], p["text"]):
                for x in _SENTENCE.split(t or ""):
                    found = {BEGIN + u for u in units(x)}
                    count[int(y)].update((u for u in found if marked.search(u)) if y else found)
            both = list(count[0].keys() | count[1].keys())
            yield pd.DataFrame({"unit": pd.Series(both, dtype=object), "pos": np.array([count[1][u] for u in both], np.int64), "neg": np.array([count[0][u] for u in both], np.int64)})

    return sample.select("label", "text").mapInPandas(run, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def clean_units(counts: DataFrame, table: np.ndarray) -> pd.DataFrame:
    """TRAIN_UNITS units of clean sentences: half those nearest to a landmark, half by hash order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            near = np.concatenate([_against(part, table).max(1) for part in _chunks(p["unit"].tolist(), 500)]) if len(p) else np.zeros(0)
            yield p.assign(near=near.round(6).astype(float))

    rows = counts.where("neg > 0").select("unit", "neg").mapInPandas(run, "unit string, neg long, near double")
    half = [rows.orderBy(F.desc("near"), "unit").limit(TRAIN_UNITS // 2), rows.orderBy(F.xxhash64("unit"), "unit").limit(TRAIN_UNITS // 2)]
    return pd.concat([h.toPandas() for h in half], ignore_index=True).drop_duplicates("unit")


def _symmetric(k: np.ndarray) -> np.ndarray:
    return (k + k.T) / 2


def fit(docs: DataFrame, labels: DataFrame) -> Machine | float:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label)."""
    spark = docs.sparkSession
    ship(spark)
    total = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if not total.get(1) or not total.get(0):
        return 1.0 if total.get(1) else 0.0
    first = [labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for c in (0, 1)]
    chosen = first[0].unionByName(first[1])
    # at most 2 * TRAIN_DOCS ids: bounded, so they may be broadcast
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    sample = materialise(text.join(F.broadcast(chosen), "doc_id").select("label", "text").distinct(), "toxicity-sample")
    marks = choose_marks(materialise(unit_contexts(sample), "toxicity-contexts"), LANDMARKS - BACKGROUND)
    if not len(marks):
        return 0.0
    counts = materialise(labelled_sentences(sample, marks["gram"].tolist()), "toxicity-sentences")
    clean = [r["unit"] for r in counts.where("pos = 0 and length(unit) > 3").orderBy(F.desc("neg"), "unit").limit(BACKGROUND).collect()]
    chosen_marks = bare(marks, counts)
    order = sorted(range(len(marks)), key=lambda k: chosen_marks[k].startswith(BEGIN))  # those found within words first
    marks, chosen_marks = marks.iloc[order].reset_index(drop=True), [chosen_marks[k] for k in order]
    within = sum(not g.startswith(BEGIN) for g in chosen_marks)
    landmarks = chosen_marks + clean
    table = _table(landmarks)
    gate = table[:, : len(marks)].max(1)
    found = [counts.where("pos > 0").orderBy(F.desc("pos"), "unit").limit(TRAIN_UNITS).toPandas(), clean_units(counts, gate[:, None])]
    # clean documents hold next to none of these: one is enough for a toxic text, disguised or not
    telling = [k for k, (a, b) in enumerate(zip(marks["pos"], marks["neg"])) if b <= 0.02 * a]
    plain = [chosen_marks[k] for k in telling]
    forms = [disguised(g) for g in plain]
    extra = pd.DataFrame({"unit": [x for f in forms for x in f], "pos": [marks["pos"].iloc[k] / len(f) for k, f in zip(telling, forms) for _ in f], "neg": 0.0})
    forms = [x for f in forms for x in f]
    examples = pd.concat([*found, extra], ignore_index=True).fillna(0)
    kernel = np.concatenate([_against(part, table, within) for part in _chunks(examples["unit"].tolist(), 500)])
    kernel = np.where(_gated(examples["unit"].tolist(), gate)[:, None], kernel, 0.0) ** POWER
    value, vector = np.linalg.eigh(_symmetric(_against(landmarks, table, within).astype(float)) ** POWER)
    white = vector / np.sqrt(np.maximum(value, 1e-3))  # Nystrom: the landmarks' kernel to the power -1/2
    w, bias = train_machine(kernel @ white, examples["pos"].to_numpy(float), examples["neg"].to_numpy(float), COST)
    beta = white @ w
    key = hashlib.sha256("\n".join(landmarks).encode() + beta.tobytes()).hexdigest()
    machine = Machine(gate, table, beta, bias, within, key=key, halves=_halves([g.removeprefix(BEGIN) for g in plain]))
    shared = spark.sparkContext.broadcast(machine)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _few(parts):
            yield pd.DataFrame({"label": p["label"], "margins": list(shared.value.margins(p["text"].tolist()))})

    rows = sample.mapInPandas(run, "label int, margins array<double>").toPandas()  # at most 2 * TRAIN_DOCS rows, texts of a repeated id aside
    once = [x for g in plain for x in disguised(g)[: len(g.removeprefix(BEGIN)) - 1]]  # one letter put in
    alone = machine.margins([x.removeprefix(BEGIN) for x in plain + once])
    y = np.concatenate([rows["label"].to_numpy(), np.ones(len(alone), int)])
    all_margins = np.concatenate([np.stack(rows["margins"].to_numpy()), alone])
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    clean_tops = all_margins[y == 0, 0]
    # one plain insult is enough even where clean texts come near it
    machine.least = max(0.0, min(float(np.quantile(clean_tops, 1 - SLIPS)), *machine.margins([x.removeprefix(BEGIN) for x in plain])[:, 0].tolist() or [np.inf])) if len(clean_tops) else 0.0
    rest = all_margins[:, 0] < machine.least  # of these only several units together tell
    if len(set(y[rest].tolist())) == 2:
        x = evidence(all_margins[rest], bias)
        machine.slope = logistic(x, y[rest], weight[rest] / weight[rest].mean())
        machine.shift = -boundary(x @ machine.slope, y[rest], weight[rest])
        machine.steep = max(1.0, -machine.shift / (machine.least - bias))  # no unit's margin says more against a text than no evidence does
    return machine


def _chunks(items, n: int) -> Iterator:
    return (items[k : k + n] for k in range(0, len(items), n))


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn_from) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; only ``labels`` where ``learn_from(doc_id)`` holds are learned."""
    spark = docs.sparkSession
    machine = fit(docs, labels.where(learn_from(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(machine)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = m.scores(part.column(1).to_pylist()) if isinstance(m, Machine) else np.full(part.num_rows, float(m))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
