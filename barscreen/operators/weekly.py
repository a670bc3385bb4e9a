"""Daily bars to weekly bars, and which weeks count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..config import required_years
from ..functions.cleaning import week_end as week_end_of


def _date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def ohlcv(order: Column | str) -> list[Column]:
    """First open, highest high, lowest low, last close and total volume.

    ``max_by`` passes over rows whose key is null, which is how a missing price
    yields to the nearest one that is there. The total of nothing is 0.
    """
    order = F.col(order) if isinstance(order, str) else order

    def where_present(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), order)

    return [
        F.min_by("open", where_present("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", where_present("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    ]


def bar_order(bars: DataFrame) -> Column:
    """What orders the bars within a day or week: ``bar_order`` if there is one."""
    return F.col("bar_order" if "bar_order" in bars.columns else "session_date")


def weekly_bars(bars: DataFrame, week_end: str = K.WEEK_END_DAY) -> DataFrame:
    """Weekly OHLCV per symbol, in weeks that end on ``week_end``.

    Bars are combined before the shuffle, so a symbol with a large share of all
    rows sends only its weeks. Afterwards a symbol has at most one row a week.
    """
    return bars.groupBy("symbol", week_end_of("session_date", week_end).alias("week_end")).agg(*ohlcv(bar_order(bars)))


def daily_bars(bars: DataFrame) -> DataFrame:
    """One bar per symbol and day, from bars or trades of any frequency."""
    return bars.groupBy("symbol", "session_date").agg(*ohlcv(bar_order(bars)))


def save_weekly(weekly: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Keep weekly bars as a table bucketed by symbol and sorted by week.

    Screens over it need neither the weekly aggregate nor a shuffle of its rows.
    """
    writer = weekly.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol").sortBy("symbol", "week_end")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def usable(close: str = "close", volume: str = "volume") -> Column:
    return F.col(close).isNotNull() & (F.col(volume) > 0)


def usable_weeks(weekly: DataFrame) -> DataFrame:
    """Weeks with a close and some volume. Later frames count these rows only."""
    return weekly.filter(usable())


def complete_weeks(weekly: DataFrame, as_of) -> DataFrame:
    """Weeks that are over on ``as_of``; one ending that very day is.

    Apply it before any window: a filter on weeks may not move below one.
    """
    return weekly.filter(F.col("week_end") <= _date(as_of))


def recent_only(weekly: DataFrame, as_of, max_days: int = K.RECENCY_DAYS) -> DataFrame:
    """Symbols whose last week is at most ``max_days`` old."""
    last = F.max("week_end").over(Window.partitionBy("symbol"))
    return (
        weekly.withColumn("last_week", last)
        .filter(F.datediff(_date(as_of), F.col("last_week")) <= max_days)
        .drop("last_week")
    )


def history_range(bars: DataFrame, as_of, years: float, rule: str = "days", include_end: bool = False) -> DataFrame:
    """Bars of the last ``years`` before ``as_of``: a date range that reaches the scan.

    ``rule='days'`` counts years of 365.25 days, ``'calendar'`` goes back by date.
    Bars stored by ``bar_year`` are read from the folders of those years only.
    """
    end = _date(as_of)
    if rule == "days":
        start = F.date_sub(end, int(years * K.DAYS_PER_YEAR))
    elif rule == "calendar":
        start = F.add_months(end, -int(round(12 * years)))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    if "bar_year" in bars.columns:
        bars = bars.filter(F.col("bar_year").between(F.year(start), F.year(end)))
    day = F.col("session_date")
    return bars.filter((day >= start) & ((day <= end) if include_end else (day < end)))


def screen_history(bars: DataFrame, config, as_of) -> DataFrame:
    """The bars a screen can look at, and no older ones."""
    return history_range(bars, as_of, required_years(config), "days")
