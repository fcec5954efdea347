"""How a bar DataFrame is partitioned and ordered, and the window frames built on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BarSpec:
    """Names of the symbol and time columns. Operators never look across symbols.

    With keep, an indicator adds its outputs to the table, with nulls in the warm-up, instead of giving a table of them.
    """

    symbol: str = "symbol"
    ts: str = "ts"
    keep: bool = False

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(self.ts)

    def last(self, n: int) -> WindowSpec:
        """The row and the n - 1 before it."""
        return self.order.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        """The n rows before, without the row itself."""
        return self.order.rowsBetween(-n, -1)

    def next(self, n: int) -> WindowSpec:
        """The n rows after, without the row itself."""
        return self.order.rowsBetween(1, n)

    @property
    def so_far(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return (F.lag(x, k) if k >= 0 else F.lead(x, -k)).over(self.order)

    def roll(self, f: Callable[[Column], Column], x: Column | str, n: int) -> Column:
        """f over the last n values, null until there are n of them."""
        x = F.col(x) if isinstance(x, str) else x
        return F.when(F.count(x).over(self.last(n)) == n, f(x).over(self.last(n)))


BARS = BarSpec()


def require(df: DataFrame, *columns: str) -> None:
    """ValueError if a column is missing; looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def finite(c: Column | str) -> Column:
    """NaN and infinities become null, the one sign of missing data here."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b by IEEE 754: infinite or NaN where b is 0, null where one is null."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def logarithm(x: Column) -> Column:
    """The natural logarithm by IEEE 754: minus infinity of 0, NaN of what is below, null of null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def skip(df: DataFrame, n: int, spec: BarSpec = BARS) -> DataFrame:
    """Without the first n rows of each symbol."""
    return df.withColumn("__n", F.row_number().over(spec.order)).filter(F.col("__n") > n).drop("__n")
