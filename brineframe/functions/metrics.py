"""Agreement metrics as aggregate expressions over a (truth, prediction) pair."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .missing import as_col


def _pair(t: Column | str, p: Column | str) -> tuple[Column, Column]:
    """Both sides, missing unless both are present."""
    t, p = as_col(t).cast("double"), as_col(p).cast("double")
    both = t.isNotNull() & p.isNotNull()
    return F.when(both, t), F.when(both, p)


def n_pairs(t, p) -> Column:
    return F.count(_pair(t, p)[0])


def r2(t, p) -> Column:
    """1 - residual sum of squares / total sum of squares; missing at zero variance."""
    t, p = _pair(t, p)
    return F.lit(1.0) - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))


def rmse(t, p) -> Column:
    t, p = _pair(t, p)
    return F.sqrt(F.avg((t - p) * (t - p)))


def mae(t, p) -> Column:
    t, p = _pair(t, p)
    return F.avg(F.abs(t - p))


def bias(t, p) -> Column:
    """Prediction minus truth."""
    t, p = _pair(t, p)
    return F.avg(p - t)


def bias_obs_minus_pred(t, p) -> Column:
    t, p = _pair(t, p)
    return F.avg(t - p)


def share_within_factor(t_log, p_log, factor: float) -> Column:
    """Share of pairs within a multiplicative factor, on log10 values."""
    t, p = _pair(t_log, p_log)
    near = F.abs(t - p) <= F.lit(math.log10(factor))
    return F.avg(F.when(near.isNotNull(), near.cast("double")))
