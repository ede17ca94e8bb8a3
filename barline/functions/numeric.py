"""Null-safe arithmetic and full-window rolling aggregates."""

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec

INFINITY = float("inf")


def finite(c: Column) -> Column:
    """NaN and infinities become NULL (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(c) < F.lit(INFINITY), c)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(now: Column, before: Column) -> Column:
    """Relative change; a zero base gives NULL."""
    return F.try_divide(now, before) - F.lit(1.0)


def rolling_dense(series: WindowSpec, n: int):
    """The same for columns without NULLs: the row position replaces a count per column."""
    frame = series.rowsBetween(-(n - 1), 0)
    position = F.row_number().over(series)

    def apply(aggregate, c: Column) -> Column:
        return F.when(position >= n, aggregate(c).over(frame))

    return apply


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def rolling(series: WindowSpec, n: int):
    """Aggregate over the last n rows, NULL until n non-null values are in the frame."""
    frame = series.rowsBetween(-(n - 1), 0)

    def apply(aggregate, c: Column) -> Column:
        return F.when(F.count(c).over(frame) == n, aggregate(c).over(frame))

    return apply


def number(c: Column) -> Column:
    """Text or number to double; unparsable, empty and NaN become NULL."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def finite_number(c: Column) -> Column:
    return finite(c.try_cast("double"))


def whole(c: Column) -> Column:
    """Truncate toward zero after parsing as a number."""
    return finite_number(c).cast("bigint")


def text10(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 10)


def pearson_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Correlation from sums of centred values; a (numerically) constant side gives NULL."""
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    cov = sxy - sx * sy / n
    live = (vx > sxx * F.lit(1e-12)) & (vy > syy * F.lit(1e-12))
    return F.when(live, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
