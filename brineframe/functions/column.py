"""Expressions over a depth-ordered array column.

The depth axis is short and known when the plan is built, so sums are unrolled
into plain SQL arithmetic and stay inside whole-stage code generation (higher-order
functions do not). Columns are given by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .axes import DepthAxis
from .missing import as_col


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _value(chla: str, i: int) -> str:
    return f"coalesce(double(get(`{chla}`, {i})), 0D)"


def total(chla: str, n: int) -> Column:
    """Sum over depth, missing skipped; 0 for an all-missing column."""
    return F.expr(" + ".join(_value(chla, i) for i in range(n)))


def weighted_total(chla: str, weights: list[float | str]) -> Column:
    """Weighted sum over depth; a weight is a number or SQL text."""
    return F.expr(" + ".join(
        f"{_value(chla, i)} * {w if isinstance(w, str) else _number(w)}" for i, w in enumerate(weights)
    ))


def overlap(axis: DepthAxis, limit: str | float) -> list[str]:
    """Metres of every bin lying above ``limit`` (a column name or a depth); partial bins
    count in part."""
    depth = f"double(`{limit}`)" if isinstance(limit, str) else _number(limit)
    return [
        f"greatest(0D, least({_number(e)}, {depth}) - {_number(s)})" for s, e in zip(axis.starts, axis.ends)
    ]


def peak_position(chla: str) -> Column:
    """Zero-based position of the first maximum."""
    return F.expr(f"int(array_position(`{chla}`, array_max(`{chla}`)) - 1)")


def peak_depth(chla: str, axis: DepthAxis) -> Column:
    """Bin centre of the first maximum."""
    return F.get(axis.literal(), peak_position(chla))


def integral(chla: str, axis: DepthAxis) -> Column:
    return weighted_total(chla, list(axis.thickness))


def centre_of_mass(chla: str, axis: DepthAxis) -> Column:
    return F.try_divide(weighted_total(chla, list(axis.centers)), total(chla, len(axis)))


def smooth(values: Column | str, size: int = 3) -> Column:
    """Centred moving average along an array with the edge value repeated."""
    if size < 1 or size % 2 == 0:
        raise ValueError("the window size must be odd")
    v = as_col(values)
    half = size // 2
    last = F.size(v) - 1

    def at(_, i):
        near = [F.get(v, F.greatest(F.lit(0), F.least(last, i + k))) for k in range(-half, half + 1)]
        return reduce(lambda a, b: a + b, near) / F.lit(float(size))

    return F.transform(v, at)
