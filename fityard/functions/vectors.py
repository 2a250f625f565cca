"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers (first split, split within the train side) and modulus.
SPLIT_MULTIPLIER = 2654435761
VAL_MULTIPLIER = 2246822519
SPLIT_MODULUS = 1 << 32
SPLIT_KEY_RANGE = 1 << 31


def quoted(name: str) -> Column:
    """Column by name; digit names are legal."""
    return F.col(f"`{name}`")


def dot(weights: Sequence[float], cols: Sequence[str], intercept: float = 0.0) -> Column:
    """``intercept + sum(w * x)``, added up from left to right."""
    if len(weights) != len(cols):
        raise ValueError("one weight per column is needed")
    return reduce(add, (F.lit(float(w)) * quoted(c) for w, c in zip(weights, cols)),
                  F.lit(float(intercept)))


def squared_distance(center: Sequence[float], cols: Sequence[str]) -> Column:
    terms = [(quoted(c) - F.lit(float(v))) * (quoted(c) - F.lit(float(v)))
             for v, c in zip(center, cols, strict=True)]
    return reduce(add, terms)


def nearest_center(centers: Sequence[Sequence[float]], cols: Sequence[str]) -> Column:
    """Number of the nearest center; the lowest number wins a tie."""
    distances = F.array(*[squared_distance(c, cols) for c in centers])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def as_vector(array_col: str) -> Column:
    return array_to_vector(F.col(array_col).cast("array<double>"))


def unit_hash(key: str, multiplier: int = SPLIT_MULTIPLIER) -> Column:
    """Pseudo-random number in [0, 1) that depends on an integer key only."""
    folded = F.pmod(F.col(key).cast("bigint"), F.lit(SPLIT_KEY_RANGE))
    return F.pmod(folded * F.lit(multiplier), F.lit(SPLIT_MODULUS)) / F.lit(float(SPLIT_MODULUS))


def ntz_micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone is."""
    c = F.col(ts)
    seconds = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 \
        + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECONDS"), c) * 1_000_000).cast("bigint")
