"""Result records, their order and their display."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions.formatting import chart_url, fixed, format_market_cap, ma_label, quote_url

SLIM = ("ticker", "date", "close_price", "market_cap", "avg_volume", "volume_ratio")


def rank_results(df: DataFrame, symbol: str = "ticker") -> DataFrame:
    """Highest volume ratio first; equal ratios in order of symbol."""
    return df.orderBy(F.desc("volume_ratio"), symbol)


def sort_results(df: DataFrame, column: str, ascending: bool = True, symbol: str = "ticker") -> DataFrame:
    """Sort by any column as the type it has."""
    return df.orderBy(F.asc(column) if ascending else F.desc(column), symbol)


def _slim_columns() -> list[Column]:
    return [
        F.col("symbol").alias("ticker"),
        F.col("week_end").cast("string").alias("date"),
        F.col("close").alias("close_price"),
        F.col("market_cap"),
        F.col("avg_volume"),
        F.col("volume_ratio"),
    ]


def to_slim(matches: DataFrame) -> DataFrame:
    return matches.select(*_slim_columns())


def to_rich(matches: DataFrame, config: ScreenConfig) -> DataFrame:
    """Slim record with volume and, per period, value, state and length."""
    periods = config.ma_periods

    def by_name(value) -> Column:
        return F.create_map(*chain.from_iterable((F.lit(k), value(k)) for k in periods))

    return matches.select(
        *_slim_columns(),
        F.col("volume"),
        by_name(lambda k: F.when(F.col(f"state_{k}") != "omitted", F.col(f"ma_{k}"))).alias("ma_values"),
        by_name(lambda k: F.col(f"state_{k}")).alias("ma_passes"),
        by_name(lambda k: F.lit(periods[k])).alias("ma_periods"),
    )


def to_display(results: DataFrame, dialect: str = "lookback") -> DataFrame:
    """Records as text, with links; moving-average labels where there are states."""
    shown = [
        F.col("ticker"),
        F.col("date"),
        fixed(F.col("close_price"), 2).alias("close_price"),
        format_market_cap("market_cap", dialect).alias("market_cap"),
        F.format_number("avg_volume", 0).alias("avg_volume"),
        F.concat(fixed(F.col("volume_ratio"), 2), F.lit("x")).alias("volume_ratio"),
    ]
    if "ma_passes" in results.columns:
        shown += [
            ma_label(F.try_element_at("ma_passes", F.lit(k))).alias(f"ma_{k}_pass")
            for k in ScreenConfig().ma_periods
        ]
    return results.select(*shown, quote_url("ticker").alias("quote_url"), chart_url("ticker").alias("chart_url"))
