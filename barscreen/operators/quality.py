"""Company info joins and data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OHLCV


def drop_empty_bars(bars: DataFrame) -> DataFrame:
    """Drop bars without any price or volume."""
    return bars.na.drop("all", subset=list(OHLCV))


def valid_info(info: DataFrame) -> DataFrame:
    """Info of symbols that have a market price; the others count as having none."""
    return info.filter(F.col("regular_market_price").isNotNull())


def attach_info(rows: DataFrame, info: DataFrame, how: str = "left") -> DataFrame:
    """Add ``market_cap`` by symbol. Rows grouped by symbol already need no new shuffle.

    There is no broadcast hint: info grows with the universe, and Spark
    broadcasts it by itself while it is small.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    return join_info(rows, one_info_per_symbol(info), how)


def join_info(rows: DataFrame, info: DataFrame, how: str = "left") -> DataFrame:
    """``attach_info`` for info that has one row a symbol already."""
    return rows.join(info.select("symbol", "market_cap"), "symbol", how)


def _with_history(bars: DataFrame) -> DataFrame:
    return drop_empty_bars(bars).select("symbol").distinct()


def _counted(symbols: DataFrame) -> DataFrame:
    """Entries per symbol, counted before they are shuffled: a list may name one symbol very often."""
    return symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("entries"))


def _unfolded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entry", F.explode(F.sequence(F.lit(1).cast("long"), "entries"))).drop("entry", "entries")


def listed(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of the symbols that a list names, however often it does."""
    return rows.join(_counted(symbols), "symbol", "left_semi")


def repeated(rows: DataFrame, symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Rows of listed symbols, as often as the list names them."""
    entries = _counted(symbols).withColumnRenamed("symbol", symbol)
    return _unfolded(rows.join(entries, symbol))


def missing_symbols(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested symbols without any bar, as often as they are requested."""
    return _unfolded(_counted(symbols).join(_with_history(bars), "symbol", "left_anti"))


def one_info_per_symbol(info: DataFrame) -> DataFrame:
    """(symbol, market_cap, regular_market_price): of several rows the largest price, and the largest cap of those with a price."""
    cap = F.col("market_cap")
    if "regular_market_price" not in info.columns:
        return info.groupBy("symbol").agg(F.max(cap).alias("market_cap"))
    price = F.col("regular_market_price")
    best = F.coalesce(F.max(F.when(price.isNotNull(), cap)), F.max(cap))
    return info.groupBy("symbol").agg(best.alias("market_cap"), F.max(price).alias("regular_market_price"))


def coverage_report(symbols: DataFrame, bars: DataFrame, info: DataFrame) -> DataFrame:
    """One row: entries requested, without history, without info, without market cap.

    Info and cap are judged only where there is history. Repeated entries count
    each time, except in ``symbols_saved``.
    """
    requested = symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("entries"))
    flags = (
        requested.join(_with_history(bars).withColumn("has_history", F.lit(True)), "symbol", "left")
        .join(valid_info(info).select("symbol", "market_cap", F.lit(True).alias("has_info")), "symbol", "left")
        .withColumn("has_history", F.coalesce("has_history", F.lit(False)))
        .withColumn("has_info", F.coalesce("has_info", F.lit(False)))
    )

    def entries(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("entries"))), F.lit(0))

    history, known = F.col("has_history"), F.col("has_info")
    return flags.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("symbols_requested"),
        F.count_if(history).alias("symbols_saved"),
        entries(~history).alias("no_history"),
        entries(history & ~known).alias("no_info"),
        entries(history & known & F.col("market_cap").isNull()).alias("no_market_cap"),
    )
