"""Roles that the given tables play: price histories, company info, settings.

A supplier stands for a symbol: its shipments are trades with a price
(``l_extendedprice``) and a volume (``l_quantity``). Its balance is its market
cap in millions, unknown when negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen import ScreenConfig, bars_from_table, info_from_table, weekly_bars
from barscreen.functions.cleaning import DAY_NUMBER, packed_order

AS_OF = "2001-11-04"

# Short periods, so that every moving average is in play.
SHORT = ScreenConfig(
    volume_multiplier=1.2,
    price_avg_weeks=1,
    ma_short=9,
    ma_intermediate=18,
    ma_medium=36,
    ma_long=70,
    avg_volume_weeks=13,
    lookback_weeks=13,
)
CAPPED = ScreenConfig(
    min_market_cap=500.0,
    max_market_cap=8000.0,
    volume_multiplier=1.1,
    price_avg_weeks=2,
    ma_short=4,
    ma_intermediate=8,
    ma_medium=16,
    ma_long=400,
    avg_volume_weeks=6,
    lookback_weeks=26,
)
NEWEST = ScreenConfig(
    max_market_cap=9000.0,
    volume_multiplier=0.8,
    price_avg_weeks=1,
    ma_short=3,
    ma_intermediate=6,
    ma_medium=12,
    ma_long=24,
    avg_volume_weeks=13,
)
DEFAULT = ScreenConfig(lookback_weeks=52, volume_multiplier=1.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade_order() -> Column:
    """Date, order, line and part of a shipment; digits for 100,000 times the unit scale."""
    return packed_order(
        (DAY_NUMBER.format(date="l_shipdate"), 7), ("l_orderkey", 15), ("l_linenumber", 2), ("l_partkey", 14)
    )


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_table(
        table(spark, sf_dir, "lineitem"),
        symbol="l_suppkey",
        ts="l_shipdate",
        close="l_extendedprice",
        volume="l_quantity",
        tiebreak=_trade_order(),
    )


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier bars with holes: returned goods have no figures, open lines no volume."""
    returned = F.col("l_returnflag") == "R"
    price = F.when(returned, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    volume = F.when(F.col("l_linestatus") == "O", F.lit(0.0)).otherwise(F.col("l_quantity"))
    return bars_from_table(
        table(spark, sf_dir, "lineitem"),
        symbol="l_suppkey",
        ts="l_shipdate",
        close=price,
        volume=F.when(returned, F.lit(None)).otherwise(volume),
        tiebreak=_trade_order(),
    )


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few symbols with a great many trades each."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    trades = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return bars_from_table(
        trades,
        symbol="p_brand",
        ts="l_shipdate",
        close="l_extendedprice",
        volume="l_quantity",
        high=F.col("l_extendedprice") * 1.5,
        low=F.col("l_extendedprice") * 0.5,
        open=F.col("l_extendedprice") - F.col("l_discount"),
        tiebreak=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
    )


def customer_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_table(
        table(spark, sf_dir, "orders"),
        symbol="o_custkey",
        ts="o_orderdate",
        close="o_totalprice",
        volume=F.lit(1.0),
        tiebreak=packed_order((DAY_NUMBER.format(date="o_orderdate"), 7), ("o_orderkey", 18)),
    )


def _info(df: DataFrame, key: str, balance: str, nation: str) -> DataFrame:
    cap = F.when(F.col(balance) >= 0, F.col(balance) * 1_000_000)
    price = F.when(F.col(nation) != 0, F.abs(F.col(balance)))
    return info_from_table(df, key, cap, price)


def supplier_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", "s_nationkey")


def listed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info of some suppliers only, so that the others have none."""
    return supplier_info(spark, sf_dir).filter(F.col("regular_market_price").isNotNull())


def customer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", "c_nationkey")


def supplier_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_bars(supplier_bars(spark, sf_dir))


def gappy_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_bars(gappy_bars(spark, sf_dir))
