"""Weeks to judge, with everything the conditions look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions import predicates as P
from ..functions.trailing import (
    SYMBOL_WEEKS,
    bar_age,
    bar_position,
    moving_averages,
    preceding_mean,
    scaled,
    trailing_mean,
    volume_ratio,
    without_scales,
)
from ..plans.dialects import Dialect
from .weekly import complete_weeks, usable, usable_weeks


def finished_weeks(weekly: DataFrame, as_of) -> DataFrame:
    """Usable weeks that are over. ``as_of=None`` says that all of them are."""
    weeks = usable_weeks(weekly)
    return weeks if as_of is None else complete_weeks(weeks, as_of)


def placed_weeks(
    weeks: DataFrame, window: str = SYMBOL_WEEKS, counted: str = "1", flags: tuple[str, ...] = ()
) -> DataFrame:
    """Weeks with their ``age`` and the number of weeks before them.

    Selecting windowed columns on top of this shuffles by symbol once, and
    before the columns' decimal inputs exist, which would double its volume.
    A symbol has one row a week, so no group is large.
    """
    places = [bar_age(window, counted).alias("age"), bar_position(window).alias("bars_before")]
    return weeks.select("symbol", "week_end", "close", "volume", *flags, *places)


def judged_weeks(weeks: DataFrame, columns: list[Column], lookback: int, longest: int) -> DataFrame:
    """The newest ``lookback`` weeks of each symbol with their windowed ``columns``.

    No column looks back further than ``longest`` weeks, so older weeks are
    dropped between placing and windowing.
    """
    return windowed_weeks(placed_weeks(weeks), columns, lookback, longest)


def windowed_weeks(
    placed: DataFrame, columns: list[Column], lookback: int, longest: int, window: str = SYMBOL_WEEKS
) -> DataFrame:
    within_reach = scaled(placed.filter(F.col("age") <= lookback + max(longest, 0) + 1), window=window)
    return without_scales(within_reach.select("*", *columns).filter(F.col("age") <= lookback))


def screen_columns(config: ScreenConfig, window: str = SYMBOL_WEEKS) -> list[Column]:
    return [
        trailing_mean("volume", config.avg_volume_weeks, window=window, method="prefix").alias("avg_volume"),
        preceding_mean("close", config.price_avg_weeks, window=window, method="prefix").alias("recent_mean"),
        *moving_averages(config.ma_periods, window=window, method="prefix"),
    ]


def longest_frame(config: ScreenConfig) -> int:
    return max(config.avg_volume_weeks, config.price_avg_weeks, *config.ma_periods.values())


def judged(weekly: DataFrame, config: ScreenConfig, dialect: Dialect, as_of) -> DataFrame:
    """Judged weeks with ratio, moving-average states and one flag per condition."""
    features = judged_weeks(
        finished_weeks(weekly, as_of), screen_columns(config), dialect.lookback(config), longest_frame(config)
    )
    return with_conditions(features, config, dialect, as_of)


# Finished weeks come first, oldest to newest, so frames before one hold such weeks only.
FINISHED_FIRST = "PARTITION BY symbol ORDER BY finished DESC, week_end"


def judged_and_rejected(weekly: DataFrame, config: ScreenConfig, dialect: Dialect, as_of) -> DataFrame:
    """The rows of ``judged`` and, with ages below 1, all weeks that do not count.

    ``finished`` tells them apart; ``usable`` holds for weeks that are merely not over.
    Both kinds come from one pass over the weekly table.
    """
    over = F.lit(True) if as_of is None else F.col("week_end") <= F.lit(str(as_of)).cast("date")
    flagged = weekly.select("symbol", "week_end", "close", "volume", F.coalesce(usable(), F.lit(False)).alias("usable"))
    flagged = flagged.withColumn("finished", F.col("usable") & over)
    placed = placed_weeks(flagged, FINISHED_FIRST, "CASE WHEN finished THEN 1 END", ("usable", "finished"))
    columns = screen_columns(config, FINISHED_FIRST)
    features = windowed_weeks(placed, columns, dialect.lookback(config), longest_frame(config), FINISHED_FIRST)
    return with_conditions(features, config, dialect, as_of)


def with_conditions(features: DataFrame, config: ScreenConfig, dialect: Dialect, as_of, recency: bool = True) -> DataFrame:
    states = {f"state_{name}": P.ma_state(n, f"ma_{name}") for name, n in config.ma_periods.items()}
    return features.select("*", *[state.alias(name) for name, state in states.items()]).select(
        "*",
        volume_ratio().alias("volume_ratio"),
        (recent_enough(dialect, as_of) if recency else F.lit(True)).alias("is_recent"),
        P.old_enough(
            config.ma_short,
            config.ma_intermediate,
            config.avg_volume_weeks,
            extra_weeks=dialect.extra_weeks,
            gate_intermediate=dialect.gate_intermediate,
        ).alias("is_old_enough"),
        P.volume_spike(config.volume_multiplier).alias("is_spike"),
        P.price_above_recent(config.price_avg_weeks, dialect.zero_window_passes).alias("is_rising"),
        P.all_ma_hold(list(states)).alias("is_above_averages"),
    )


def recent_enough(dialect: Dialect, as_of) -> Column:
    if dialect.max_age_days is None:
        return F.lit(True)
    if as_of is None:
        raise ValueError(f"dialect {dialect.name!r} needs as_of to tell which weeks are recent")
    return F.datediff(F.lit(str(as_of)).cast("date"), F.col("week_end")) <= dialect.max_age_days


CONDITIONS = ("is_recent", "is_old_enough", "is_spike", "is_rising", "is_above_averages")


def all_conditions() -> Column:
    met = F.col(CONDITIONS[0])
    for name in CONDITIONS[1:]:
        met = met & F.col(name)
    return met


def matching_weeks(weekly: DataFrame, config: ScreenConfig, dialect: Dialect, as_of) -> DataFrame:
    """Every judged week that meets all conditions but the market cap."""
    return judged(weekly, config, dialect, as_of).filter(all_conditions()).drop(*CONDITIONS)


def newest_match(matches: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The newest match per symbol. Matches are partitioned by symbol already."""
    newest = Window.partitionBy(*keys).orderBy("age")
    return matches.withColumn("place", F.row_number().over(newest)).filter(F.col("place") == 1).drop("place")
