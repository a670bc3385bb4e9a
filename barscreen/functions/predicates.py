"""The conditions of a screen, as boolean columns.

Thresholds may be Python numbers (one screen) or columns (many screens).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .trailing import bar_position, trailing_mean


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def market_cap_between(min_m, max_m, cap: Column | str = "market_cap") -> Column:
    """Cap within inclusive bounds in millions; 0 disables a bound.

    A symbol of unknown cap passes unless there is a lower bound.
    """
    cap = F.col(cap) if isinstance(cap, str) else cap
    min_m, max_m = _lit(min_m), _lit(max_m)
    millions = cap / 1_000_000
    inside = ((min_m <= 0) | (millions >= min_m)) & ((max_m <= 0) | (millions <= max_m))
    return F.when(cap.isNull(), min_m <= 0).otherwise(inside)


def volume_spike(mult, volume: Column | str = "volume", average: Column | str = "avg_volume") -> Column:
    """Volume at least ``mult`` times its average; never on a missing or zero average."""
    volume = F.col(volume) if isinstance(volume, str) else volume
    average = F.col(average) if isinstance(average, str) else average
    return F.coalesce((average != 0) & (volume >= _lit(mult) * average), F.lit(False))


def price_above_recent(weeks, zero_window_passes: bool, close="close", recent="recent_mean", before="bars_before"):
    """Close strictly above the mean of the ``weeks`` closes before it."""
    close, recent, before = (F.col(x) if isinstance(x, str) else x for x in (close, recent, before))
    weeks = _lit(weeks)
    above = F.coalesce((before >= weeks) & (close > recent), F.lit(False))
    return F.when(weeks <= 0, F.lit(zero_window_passes)).otherwise(above)


def ma_state(n, average: Column | str, close: Column | str = "close", before: Column | str = "bars_before") -> Column:
    """'omitted' for a symbol too young for the period, else 'pass' or 'fail'."""
    close, average, before = (F.col(x) if isinstance(x, str) else x for x in (close, average, before))
    return F.when(before < _lit(n), F.lit("omitted")).when(close > average, F.lit("pass")).otherwise(F.lit("fail"))


def ma_states(periods: dict[str, int], c: str = "close", prefix: str = "state_", **options) -> list[Column]:
    """Moving-average states over a weekly table, one per named period."""
    return [
        ma_state(n, trailing_mean(c, n, **options), c, bar_position()).alias(f"{prefix}{name}")
        for name, n in periods.items()
    ]


def all_ma_hold(states: list[Column | str]) -> Column:
    """No moving average fails."""
    columns = [F.col(s) if isinstance(s, str) else s for s in states]
    return reduce(lambda a, b: a & b, [s != F.lit("fail") for s in columns])


def old_enough(short, intermediate, volume_weeks, *, extra_weeks: int, gate_intermediate: bool, before="bars_before"):
    """Enough weeks of history before the judged week."""
    before = F.col(before) if isinstance(before, str) else before
    ok = (before >= _lit(short) + extra_weeks) & (before >= _lit(volume_weeks) + extra_weeks)
    if gate_intermediate:
        intermediate = _lit(intermediate)
        ok = ok & ((intermediate <= 0) | (before >= intermediate))
    return ok
