"""The screens."""

from dataclasses import replace

from pyspark.sql import functions as F

import barscreen as bs
from barscreen.config import settings_frame
from barscreen.session import scratch_path

from . import bindings as B
from . import sqltext as S
from .registry import query

_SLIM = ("ticker", "date", "close_price", "market_cap", "avg_volume", "volume_ratio")


def rounded(df):
    """Means and ratios to 6 places, below the noise of double arithmetic."""
    return df.withColumns({c: F.round(c, 6) for c in ("avg_volume", "volume_ratio")})


def lookback(spark, sf_dir, config):
    return bs.screen(
        B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir), config, "lookback", B.AS_OF
    )


@query(S.screen_sql(B.SHORT, "lookback"))
def screen_lookback(spark, sf_dir):
    return rounded(lookback(spark, sf_dir, B.SHORT))


@query(S.screen_sql(B.CAPPED, "lookback"))
def screen_lookback_capped(spark, sf_dir):
    return rounded(lookback(spark, sf_dir, B.CAPPED))


@query(S.screen_sql(B.DEFAULT, "lookback"))
def screen_lookback_default(spark, sf_dir):
    """Default periods: most symbols are too young for the two longest."""
    return rounded(lookback(spark, sf_dir, B.DEFAULT))


@query(S.screen_sql(B.NEWEST, "snapshot", S.LISTED_INFO))
def screen_snapshot(spark, sf_dir):
    weekly, info = B.supplier_weekly(spark, sf_dir), B.listed_info(spark, sf_dir)
    return rounded(bs.screen(weekly, info, B.NEWEST, "snapshot", B.AS_OF))


_OBSERVED = S.with_(S.SUPPLIER_BARS, S.WEEKLY, S.finished(), S.features(B.CAPPED), S.LISTED_INFO, S.matches(B.CAPPED, "lookback"))


@query(
    f"""{_OBSERVED} SELECT {S.SLIM}, (SELECT count(*) FROM matches) AS matched,
    (SELECT count(DISTINCT symbol) FROM bars) AS total FROM matches"""
)
def screen_observed(spark, sf_dir):
    """Records with the numbers of matched and of all symbols, which the run itself has counted."""
    path = scratch_path(spark, "observed")
    records, seen = bs.observed_screen(B.supplier_weekly(spark, sf_dir), B.listed_info(spark, sf_dir), B.CAPPED, "lookback", B.AS_OF)
    records.write.parquet(path)
    counts = [F.lit(seen.get[c]).cast("long").alias(c) for c in ("matched", "total")]
    return rounded(spark.read.parquet(path)).select("*", *counts)


_FLAT = (1e-10, 1.0, 1e15)


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.WEEKLY)} SELECT CAST(NULL AS VARCHAR) AS ticker, CAST(NULL AS VARCHAR) AS date,
    CAST(NULL AS DOUBLE) AS close_price, CAST(NULL AS DOUBLE) AS market_cap, CAST(NULL AS DOUBLE) AS avg_volume,
    CAST(NULL AS DOUBLE) AS volume_ratio FROM weekly WHERE week_end IS NULL"""
)
def screen_lookback_flat(spark, sf_dir):
    """A price that never moves, tiny, plain or huge, never rises above its mean: no week matches."""
    key = F.pmod(F.xxhash64("symbol"), F.lit(len(_FLAT))).cast("int")
    price = F.get(F.array(*[F.lit(x) for x in _FLAT]), key) * (1 + F.pmod(F.xxhash64("symbol", F.lit(1)), F.lit(1000)) / 7)
    weekly = B.supplier_weekly(spark, sf_dir).withColumn("close", price)
    return rounded(bs.screen(weekly, B.supplier_info(spark, sf_dir), replace(B.SHORT, volume_multiplier=0.01), "lookback", B.AS_OF))


_YEARS = bs.required_years(B.NEWEST)
_LIVE_BARS = S.SUPPLIER_BARS.replace(
    "FROM lineitem",
    f"""FROM lineitem
  WHERE CAST(l_shipdate AS DATE) >= DATE '{B.AS_OF}' - {int(_YEARS * 365.25)}
    AND CAST(l_shipdate AS DATE) < DATE '{B.AS_OF}'""",
)
_RICH = ", ".join(
    [S.SLIM, "volume"]
    + [f"round(CASE WHEN b >= {n} THEN ma_{k} END, 6) AS ma_{k}" for k, n in B.NEWEST.ma_periods.items()]
    + [f"{S.state(k, n)} AS state_{k}" for k, n in B.NEWEST.ma_periods.items()]
    + [f"{n} AS weeks_{k}" for k, n in B.NEWEST.ma_periods.items()]
)
_LIVE = S.with_(
    _LIVE_BARS, S.WEEKLY, S.finished(), S.features(B.NEWEST), S.SUPPLIER_INFO, S.matches(B.NEWEST, "live")
)


def flat(rich):
    """Rich records with one column per moving average in place of the maps."""
    names = list(B.NEWEST.ma_periods)
    return rich.select(
        *[c for c in rich.columns if not c.startswith("ma_")],
        *[F.round(F.col("ma_values")[k], 6).alias(f"ma_{k}") for k in names],
        *[F.col("ma_passes")[k].alias(f"state_{k}") for k in names],
        *[F.col("ma_periods")[k].alias(f"weeks_{k}") for k in names],
    )


def live(spark, sf_dir, symbols=None):
    bars, info = B.supplier_bars(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return bs.screen_bars(bars, info, B.NEWEST, "live", B.AS_OF, symbols)


@query(f"{_LIVE} SELECT {_RICH} FROM matches")
def screen_live(spark, sf_dir):
    return flat(rounded(live(spark, sf_dir)))


@query(
    f"""{_LIVE} SELECT {S.SLIM} FROM matches
    JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem) USING (symbol)"""
)
def screen_live_repeats(spark, sf_dir):
    """A list that names symbols several times reports them as often: here every shipment's supplier."""
    symbols = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"))
    return rounded(live(spark, sf_dir, symbols)).select(*_SLIM)


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.WEEKLY, S.finished(), S.features(B.SHORT), S.SUPPLIER_INFO,
        S.matches(B.SHORT, "lookback", newest=False))} SELECT {S.SLIM}, age FROM matches"""
)
def matching_weeks(spark, sf_dir):
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    found = bs.matching_weeks(weekly, info, B.SHORT, B.AS_OF)
    return rounded(_slim_with_age(found))


def _slim_with_age(found):
    return found.select(
        F.col("symbol").alias("ticker"),
        F.date_format("week_end", "yyyy-MM-dd").alias("date"),
        F.col("close").alias("close_price"),
        "market_cap",
        "avg_volume",
        "volume_ratio",
        "age",
    )


SWEEP = {
    "short": B.SHORT,
    "capped": B.CAPPED,
    "default": B.DEFAULT,
    **{
        f"mult{int(m * 100)}_look{weeks}": replace(B.SHORT, volume_multiplier=m, lookback_weeks=weeks)
        for m in (1.0, 1.5, 2.0)
        for weeks in (1, 4, 26)
    },
}


def sweep_sql(configs, dialect="lookback", select=S.SLIM):
    """One SELECT per screen over shared weekly bars."""
    parts = []
    for name, c in configs.items():
        parts.append(
            f"""SELECT '{name}' AS config_id, {select} FROM (
              WITH {S.features(c)}, {S.matches(c, dialect)} SELECT * FROM matches)"""
        )
    ctes = S.with_(S.SUPPLIER_BARS, S.WEEKLY, S.finished(), S.SUPPLIER_INFO)
    return f"{ctes} {' UNION ALL '.join(parts)}"


@query(sweep_sql(SWEEP))
def screen_many(spark, sf_dir):
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return rounded(bs.screen_many(weekly, info, SWEEP, "lookback", B.AS_OF))


@query(sweep_sql(SWEEP))
def screen_many_indexed(spark, sf_dir):
    """The same screens as a table: an index of their thresholds, whatever their number."""
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return rounded(bs.screen_indexed(weekly, info, settings_frame(spark, SWEEP), "lookback", B.AS_OF))


@query(sweep_sql({k: replace(B.NEWEST, volume_multiplier=m) for k, m in (("low", 0.5), ("high", 1.0))}, "snapshot"))
def screen_many_snapshot(spark, sf_dir):
    configs = {k: replace(B.NEWEST, volume_multiplier=m) for k, m in (("low", 0.5), ("high", 1.0))}
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return rounded(bs.screen_many(weekly, info, configs, "snapshot", B.AS_OF))


_TWO = {k: replace(B.NEWEST, volume_multiplier=m) for k, m in (("low", 0.5), ("high", 1.0))}


@query(
    f"""SELECT * FROM ({sweep_sql(_TWO, "live", _RICH)}) AS found
    JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS ticker FROM lineitem WHERE l_linenumber = 1) AS listed USING (ticker)"""
)
def screen_many_live(spark, sf_dir):
    """Rich records of two screens, repeated as a list repeats its symbols: the suppliers of first lines."""
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    first = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").cast("string").alias("symbol"))
    return flat(rounded(bs.screen_many(weekly, info, _TWO, "live", B.AS_OF, first)))


@query(
    f"""SELECT * FROM ({sweep_sql(_TWO, "live", _RICH)}) AS found
    JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS ticker FROM lineitem WHERE l_linenumber = 1) AS listed USING (ticker)"""
)
def screen_many_indexed_live(spark, sf_dir):
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    first = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").cast("string").alias("symbol"))
    return flat(rounded(bs.screen_indexed(weekly, info, settings_frame(spark, _TWO), "live", B.AS_OF, first)))


@query(S.screen_sql(B.SHORT, "lookback"))
def info_repeats(spark, sf_dir):
    """Info that holds every symbol twice, once without figures, doubles no result."""
    info = B.supplier_info(spark, sf_dir)
    bare = info.select("symbol", F.lit(None).cast("double").alias("market_cap"), F.lit(None).cast("double").alias("regular_market_price"))
    return rounded(bs.screen(B.supplier_weekly(spark, sf_dir), bare.union(info), B.SHORT, "lookback", B.AS_OF))
