"""Bars by day and week, and which of them count."""

from pyspark.sql import functions as F

import barscreen as bs

from . import bindings as B
from . import sqltext as S
from .registry import query

_ALL = 'symbol, week_end, "open", high, low, "close", volume'


@query(f"{S.with_(S.SUPPLIER_BARS, S.WEEKLY)} SELECT {_ALL} FROM weekly")
def weekly_bars(spark, sf_dir):
    return B.supplier_weekly(spark, sf_dir)


@query(f"{S.with_(S.GAPPY_BARS, S.WEEKLY)} SELECT {_ALL} FROM weekly")
def weekly_bars_gappy(spark, sf_dir):
    return B.gappy_weekly(spark, sf_dir)


@query(f"{S.with_(S.BRAND_BARS, S.WEEKLY)} SELECT {_ALL} FROM weekly")
def weekly_bars_brands(spark, sf_dir):
    return bs.weekly_bars(B.brand_bars(spark, sf_dir))


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.WEEKLY.replace(
        S.WEEK_END, "CAST(date_trunc('week', session_date + INTERVAL 2 DAY) + INTERVAL 4 DAY AS DATE)"))}
    SELECT {_ALL} FROM weekly"""
)
def weekly_bars_friday(spark, sf_dir):
    return bs.weekly_bars(B.supplier_bars(spark, sf_dir), week_end="Fri")


@query(f"""{S.with_(S.SUPPLIER_BARS, S.DAILY)} SELECT symbol, session_date, "open", high, low, "close", volume FROM daily""")
def daily_bars(spark, sf_dir):
    return bs.daily_bars(B.supplier_bars(spark, sf_dir))


@query(f"{S.with_(S.GAPPY_BARS, S.WEEKLY)} SELECT {_ALL} FROM weekly WHERE {S.USABLE}")
def usable_weeks(spark, sf_dir):
    return bs.usable_weeks(B.gappy_weekly(spark, sf_dir))


@query(f"{S.with_(S.SUPPLIER_BARS, S.WEEKLY)} SELECT {_ALL} FROM weekly WHERE week_end <= DATE '{B.AS_OF}'")
def complete_weeks(spark, sf_dir):
    return bs.complete_weeks(B.supplier_weekly(spark, sf_dir), B.AS_OF)


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.WEEKLY, S.finished())} SELECT {_ALL} FROM weeks
    QUALIFY date_diff('day', max(week_end) OVER (PARTITION BY symbol), DATE '{B.AS_OF}') <= 7"""
)
def recent_symbols(spark, sf_dir):
    weeks = bs.complete_weeks(bs.usable_weeks(B.supplier_weekly(spark, sf_dir)), B.AS_OF)
    return bs.recent_only(weeks, B.AS_OF)


_BAR = 'symbol, session_date, "close", volume'


@query(
    f"""{S.with_(S.SUPPLIER_BARS)} SELECT {_BAR} FROM bars
    WHERE session_date >= DATE '2000-02-29' - CAST(floor(2.5 * 365.25) AS INTEGER) AND session_date < DATE '2000-02-29'"""
)
def history_range_days(spark, sf_dir):
    bars = bs.history_range(B.supplier_bars(spark, sf_dir), "2000-02-29", 2.5, "days")
    return bars.select("symbol", "session_date", "close", "volume")


@query(
    f"""{S.with_(S.SUPPLIER_BARS)} SELECT {_BAR} FROM bars
    WHERE session_date >= DATE '1997-02-28' AND session_date <= DATE '2000-02-29'"""
)
def history_range_calendar(spark, sf_dir):
    bars = bs.history_range(B.supplier_bars(spark, sf_dir), "2000-02-29", 3, "calendar", include_end=True)
    return bars.select("symbol", "session_date", "close", "volume")


@query(
    f"""{S.with_(S.GAPPY_BARS)} SELECT {_BAR} FROM bars
    WHERE NOT ("open" IS NULL AND high IS NULL AND low IS NULL AND "close" IS NULL AND volume IS NULL)"""
)
def drop_empty_bars(spark, sf_dir):
    return bs.drop_empty_bars(B.gappy_bars(spark, sf_dir)).select("symbol", "session_date", "close", "volume")


@query(
    f"""{S.with_(S.SUPPLIER_BARS)}
    SELECT symbol, count(*) AS n_bars, min(session_date) AS first_day, max(session_date) AS last_day,
           sum(volume) AS volume, max("close") AS top_close FROM bars GROUP BY symbol"""
)
def bars_from_table(spark, sf_dir):
    return (
        B.supplier_bars(spark, sf_dir)
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.min("session_date").alias("first_day"),
            F.max("session_date").alias("last_day"),
            F.sum("volume").alias("volume"),
            F.max("close").alias("top_close"),
        )
    )
