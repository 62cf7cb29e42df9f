"""Phred scores and base letters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Base letters in state order, and the largest probability a score may stand for.
BASES, SUREST = "ACGTZ", 0.99999


def q_score(p: Column) -> Column:
    return -10 * F.log10(1 - F.least(p, F.lit(SUREST)))


def phred(p: Column) -> Column:
    """Probability as one printable character, offset 33."""
    return F.chr(F.least(F.round(33 + q_score(p)), F.lit(126)).cast("int"))


def phred_letters(p: np.ndarray) -> str:
    """``phred`` of each probability, joined."""
    score = 33 - 10 * np.log10(1 - np.minimum(p, SUREST))
    return "".join(map(chr, np.minimum(np.floor(score + 0.5), 126).astype(int).tolist()))


def phred_string(probabilities: Column) -> Column:
    return F.array_join(F.transform(probabilities, phred), "")


def base(state: Column, n_base: int) -> Column:
    """Letter of a state; flip and flop states of a base share it."""
    return F.substring(F.lit(BASES), F.pmod(state, F.lit(n_base)).cast("int") + 1, F.lit(1))


def n_base_of_weights(n: Column) -> Column:
    """Bases of a transducer with 2 b (b + 1) weights a block."""
    return F.round((F.sqrt(1 + 2 * n) - 1) / 2).cast("int")


def n_base_of_runs(n: Column) -> Column:
    return F.floor(n / 4).cast("int")
