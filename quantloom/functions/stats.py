"""Column functions that several operators share: correlations, ranks and guarded ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; NULL where a side does not vary."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(c: str | Column, *keys: str) -> Column:
    """1-based rank within keys; ties share the mean of their ranks; NULL stays NULL and comes last. Rank and ties come from one sort: ties are the rows of the same place."""
    c = col(c)
    over = Window.partitionBy(*keys).orderBy(c.asc_nulls_last())
    ties = F.count(c).over(over.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), F.rank().over(over) + (ties - 1) / 2.0)


def percentile_rank(c: str | Column, *keys: str) -> Column:
    """Average rank over the number of non-null values."""
    c = col(c)
    return average_rank(c, *keys) / F.count(c).over(Window.partitionBy(*keys))


def rolling(fn, c: str | Column, over: WindowSpec, size: int, least: int | None = None, end: int = 0) -> Column:
    """fn over the last `size` rows up to `end`; NULL with fewer than `least` (default: size) values."""
    frame = over.rowsBetween(end - size + 1, end)
    return F.when(F.count(col(c)).over(frame) >= (size if least is None else least), fn(col(c)).over(frame))


def clip(c: str | Column, low: Column, high: Column) -> Column:
    """c held between low and high; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def two_sided_p(t: float | None) -> float | None:
    """The normal two-sided p-value of a t statistic; for summary rows on the driver."""
    return None if t is None else 2 * (1 - 0.5 * (1 + math.erf(abs(t) / math.sqrt(2))))
