"""Calendar parts, session hours and look-back periods."""

import re

from pyspark.sql import Column, functions as F

from ..constants import CHART_INTERVALS, RANGE_TO_PERIOD


def temporal_columns(date: Column) -> list[Column]:
    """Day, ISO week, month and Monday-based weekday."""
    return [
        F.dayofmonth(date).alias("day"),
        F.weekofyear(date).alias("week"),
        F.month(date).alias("month"),
        F.weekday(date).alias("day_of_week"),
    ]


def session_open(utc: Column, zone: str = "Asia/Jakarta") -> Column:
    """Weekday between 09:00 and 16:00, both inclusive to the minute, in the exchange's zone."""
    local = F.from_utc_timestamp(utc, zone)
    minutes = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & minutes.between(9 * 60, 16 * 60)


def period_start(latest: Column, period: str):
    """First date of a look-back period, or None when the period keeps everything."""
    if period == "ytd":
        return F.trunc(latest, "year")
    match = re.fullmatch(r"(\d+)(mo|y|d)", period or "")
    if period == "max" or not match:
        return None
    n, unit = int(match[1]), match[2]
    if unit == "d":
        return F.date_sub(latest, n)
    return F.add_months(latest, -n * (12 if unit == "y" else 1))


def range_to_period(value: str) -> str:
    return RANGE_TO_PERIOD.get((value or "").strip().lower(), "1y")


def chart_interval(value: str) -> str:
    if value not in CHART_INTERVALS:
        raise ValueError(f"interval must be one of: {', '.join(CHART_INTERVALS)}")
    return value


def clamp_limit(value, default: int, low: int = 1, high: int = 100) -> int:
    """Requested row limit as a number in range; anything unusable takes the default."""
    try:
        return max(low, min(int(value), high))
    except (TypeError, ValueError):
        return default
