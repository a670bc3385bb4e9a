"""The screens: one plan over all symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions.predicates import market_cap_between
from ..operators import judging
from ..operators.quality import join_info, listed, one_info_per_symbol, repeated
from ..operators.records import rank_results, to_rich, to_slim
from ..operators.weekly import screen_history, weekly_bars
from .dialects import Dialect, dialect_of


def screen_matches(
    weekly: DataFrame,
    info: DataFrame,
    config: ScreenConfig,
    dialect: str = "lookback",
    as_of=None,
    symbols: DataFrame | None = None,
    all_weeks: bool = False,
) -> DataFrame:
    """Typed matches with every feature, unordered, before they become records.

    ``all_weeks`` keeps each matching week of the lookback, not only the newest.
    """
    rules = dialect_of(dialect)
    if rules.validates:
        config.validate()
    if symbols is not None:
        weekly = listed(weekly, symbols)
    info = one_info_per_symbol(info)
    weekly = _eligible(weekly, info, config, rules)
    matches = judging.matching_weeks(weekly, config, rules, as_of)
    if rules.looks_back and not all_weeks:
        matches = judging.newest_match(matches)
    return _within_cap(matches, info, config, rules, symbols)


def _eligible(weekly: DataFrame, info: DataFrame, config: ScreenConfig, rules: Dialect) -> DataFrame:
    """Leave out symbols whose cap rules them out, before any window sees them.

    These joins sit right on the weekly aggregate, on its key. Spark moves them
    below it, to the bars, if the list of symbols is small enough to broadcast;
    if not, they share the shuffle by symbol that the windows need anyway.
    """
    inside = market_cap_between(config.min_market_cap, config.max_market_cap)
    if rules.info_required or config.min_market_cap > 0:
        return weekly.join(info.filter(inside).select("symbol"), "symbol", "left_semi")
    if config.max_market_cap > 0:
        return weekly.join(info.filter(~inside).select("symbol"), "symbol", "left_anti")
    return weekly


def _within_cap(
    matches: DataFrame, info: DataFrame, config: ScreenConfig, rules: Dialect, symbols: DataFrame | None
) -> DataFrame:
    """The cap is one value per symbol, so it may come last for every dialect."""
    kept = join_info(matches, info, "inner" if rules.info_required else "left").filter(
        market_cap_between(config.min_market_cap, config.max_market_cap)
    )
    if rules.keeps_repeats and symbols is not None:
        kept = repeated(kept, symbols)
    return kept


def screen(
    weekly: DataFrame,
    info: DataFrame,
    config: ScreenConfig,
    dialect: str = "lookback",
    as_of=None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Result records of one screen: rich for ``live``, else slim and ranked.

    ``as_of=None`` says that all weeks given are over.
    """
    rules = dialect_of(dialect)
    matches = screen_matches(weekly, info, config, dialect, as_of, symbols)
    records = to_rich(matches, config) if rules.rich else to_slim(matches)
    return rank_results(records) if rules.ranked else records


def matching_weeks(weekly: DataFrame, info: DataFrame, config: ScreenConfig, as_of=None, dialect: str = "lookback"):
    """All matching weeks of the lookback, newest and older."""
    return screen_matches(weekly, info, config, dialect, as_of, all_weeks=True)


def screen_bars(
    bars: DataFrame,
    info: DataFrame,
    config: ScreenConfig,
    dialect: str = "lookback",
    as_of=None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Screen straight from bars, of which none later than ``as_of`` is read; ``live`` reads only the years it needs."""
    if dialect_of(dialect).max_age_days is not None:
        bars = screen_history(bars, config, as_of)
    elif as_of is not None:
        bars = bars.filter(F.col("session_date") <= F.lit(str(as_of)).cast("date"))
    return screen(weekly_bars(bars), info, config, dialect, as_of, symbols)
