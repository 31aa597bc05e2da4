"""Statistics that Spark lacks or defines otherwise, as column expressions."""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero, so that results of different engines agree."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def adjusted_skew(x: Column, w: WindowSpec | None = None) -> Column:
    """Skewness with the usual correction for small samples; null under three values or without variance."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    n = over(F.count(x)).cast("double")
    return F.when((n > 2) & (over(F.var_pop(x)) > 0), over(F.skewness(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column, w: WindowSpec | None = None) -> Column:
    """Excess kurtosis with the usual correction; null under four values or without variance."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    n = over(F.count(x)).cast("double")
    return F.when((n > 3) & (over(F.var_pop(x)) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * over(F.kurtosis(x)) + 6))


def clipped(x: Column, bound: float) -> Column:
    """x within [-bound, bound]; null stays null (greatest and least would pass over it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)))


def trailing(n: int, by: str = "ticker", order: str = "pos") -> WindowSpec:
    """The last n rows, this one included."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def min_periods(n: int) -> int:
    return int(0.8 * n)


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def spectral_edge(n: int, t: int) -> float:
    """The largest eigenvalue that a correlation matrix of independent series comes to in the limit."""
    return (1 + (n / t) ** 0.5) ** 2
