"""Column builders on a window over a series: returns, rolling figures, volatility estimators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def W() -> WindowSpec:  # noqa: N802
    """A symbol's rows in the order of their dates."""
    return Window.partitionBy("symbol").orderBy("date")


def ALL() -> WindowSpec:  # noqa: N802
    """All rows of a symbol."""
    return Window.partitionBy("symbol")


#: Trading sessions of a year.
YEAR = 252


def frame(n: int, shift: int = 0) -> WindowSpec:
    """The last ``n`` rows, ending ``shift`` rows before the current one."""
    return W().rowsBetween(-(n - 1) - shift, -shift)


def full(aggregate, column: Column, over: WindowSpec, n: int) -> Column:
    """The aggregate where the frame has ``n`` values, else null."""
    return F.when(F.count(column).over(over) >= n, aggregate(column).over(over))


def change(column: Column) -> Column:
    return F.try_divide(column, F.lag(column).over(W())) - 1


def log_change(column: Column) -> Column:
    return F.ln(F.try_divide(column, F.lag(column).over(W())))


def root(column: Column) -> Column:
    """Square root, null for negative values."""
    return F.when(column >= 0, F.sqrt(column))


def parkinson(high: Column, low: Column) -> Column:
    return F.sqrt(F.pow(F.ln(F.try_divide(high, low)), 2) / (4 * F.ln(F.lit(2.0)))) * F.sqrt(F.lit(float(YEAR)))


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    inner = F.lit(0.5) * F.pow(F.ln(F.try_divide(high, low)), 2) - (2 * F.ln(F.lit(2.0)) - 1) * F.pow(F.ln(F.try_divide(close, open_)), 2)
    return root(inner) * F.sqrt(F.lit(float(YEAR)))


def obv(close: Column, volume: Column) -> Column:
    step = F.coalesce(F.signum(close - F.lag(close).over(W())), F.lit(0.0))
    return step * volume


def running(column: Column, aggregate=F.sum) -> Column:
    return aggregate(column).over(W().rowsBetween(Window.unboundedPreceding, 0))
