"""Window features and conditions over all weeks."""

from pyspark.sql import functions as F

import barscreen as bs
from barscreen.functions import predicates as P
from barscreen.functions import trailing as T
from barscreen.operators.quality import attach_info

from . import bindings as B
from . import sqltext as S
from .registry import query

_PERIODS = bs.ScreenConfig().ma_periods
_SHORT = B.SHORT.ma_periods
_WEEKS = S.with_(S.SUPPLIER_BARS, S.WEEKLY, f"weeks AS (SELECT * FROM weekly WHERE {S.USABLE})")
_GAPPY = S.with_(S.GAPPY_BARS, S.WEEKLY)


def _usable(spark, sf_dir):
    """Usable weeks, with the scales that exact running sums need."""
    return bs.scaled(bs.usable_weeks(B.supplier_weekly(spark, sf_dir)))


_PREFIX = {"method": "prefix"}


def _means_sql(source: str, table: str, periods: dict, volume_weeks: int) -> str:
    cells = ", ".join(f"round({S.mean('close', n)}, 6) AS ma_{k}" for k, n in periods.items())
    return f"{source} SELECT symbol, week_end, round({S.mean('volume', volume_weeks)}, 6) AS avg_volume, {cells} FROM {table}"


def _means(weekly, periods, volume_weeks, **options):
    return weekly.select(
        "symbol",
        "week_end",
        T.avg_volume(volume_weeks, **options).alias("avg_volume"),
        *T.moving_averages(periods, **options),
    ).select("symbol", "week_end", *[F.round(c, 6).alias(c) for c in ("avg_volume", *[f"ma_{k}" for k in periods])])


@query(_means_sql(_WEEKS, "weeks", _PERIODS, 52))
def trailing_means(spark, sf_dir):
    return _means(_usable(spark, sf_dir), _PERIODS, 52, **_PREFIX)


def _resized_sql(price: str, volume: str) -> str:
    """Means, by doubles, of prices and volumes times constants; as sums of cents and units, which leave nothing to round."""
    sums = {"avg_volume": ("volume", volume, 52), **{f"ma_{k}": ('"close"', price, n) for k, n in _PERIODS.items()}}
    cells = ", ".join(f"round({S.double_mean(f'{c} * {x}', n)} / {x} * least({n}, {S.POSITION}), 2) AS {name}" for name, (c, x, n) in sums.items())
    return f"{_WEEKS} SELECT symbol, week_end, {cells} FROM weeks"


def _resized(spark, sf_dir, price, volume):
    weeks = bs.usable_weeks(B.supplier_weekly(spark, sf_dir)).withColumns(
        {"close": F.col("close") * F.lit(price), "volume": F.col("volume") * F.lit(volume)}
    )
    averages = [T.avg_volume(52, **_PREFIX).alias("avg_volume"), *T.moving_averages(_PERIODS, **_PREFIX)]
    means = bs.scaled(weeks).select("symbol", "week_end", T.bar_position().alias("b"), *averages)
    sizes = {"avg_volume": (volume, 52), **{f"ma_{k}": (price, n) for k, n in _PERIODS.items()}}
    sums = [F.round(F.col(c) / F.lit(x) * F.least(F.lit(n), "b"), 2).alias(c) for c, (x, n) in sizes.items()]
    return means.select("symbol", "week_end", *sums)


@query(_resized_sql("1e-10", "1e0"))
def trailing_means_tiny(spark, sf_dir):
    return _resized(spark, sf_dir, 1e-10, 1.0)


@query(_resized_sql("1e0", "1e12"))
def trailing_means_huge(spark, sf_dir):
    return _resized(spark, sf_dir, 1.0, 1e12)


@query(
    f"""{_WEEKS} SELECT symbol, week_end, {", ".join(
        f"round(({S.mean('close', n)}) * least({n}, {S.POSITION}), 4) AS sum_{k}" for k, n in _SHORT.items())} FROM weeks"""
)
def trailing_means_frames(spark, sf_dir):
    """Means of re-summed frames, times their length: sums of cents leave nothing to round."""
    means = _usable(spark, sf_dir).select(
        "symbol", "week_end", T.bar_position().alias("b"), *T.moving_averages(_SHORT, method="frames")
    )
    sums = [F.round(F.col(f"ma_{k}") * F.least(F.lit(n), "b"), 4).alias(f"sum_{k}") for k, n in _SHORT.items()]
    return means.select("symbol", "week_end", *sums)


def _values_in_frame(n):
    """SQL: how many closes the frame before a week holds."""
    return f'count("close") OVER (PARTITION BY symbol ORDER BY week_end ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)'


@query(
    f"""{_GAPPY} SELECT symbol, week_end, {", ".join(
        f"round(({S.mean('close', n)}) * {_values_in_frame(n)}, 4) AS sum_{k}" for k, n in _SHORT.items())} FROM weekly"""
)
def trailing_means_gappy(spark, sf_dir):
    """Weeks without a close stay in, so the minimum number of values matters."""
    def values(n):
        return F.expr(f"count(close) OVER ({T.SYMBOL_WEEKS} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)")

    means = bs.scaled(B.gappy_weekly(spark, sf_dir)).select(
        "symbol",
        "week_end",
        *T.moving_averages(_SHORT, **_PREFIX),
        *[values(n).alias(f"n_{k}") for k, n in _SHORT.items()],
    )
    return means.select(
        "symbol", "week_end", *[F.round(F.col(f"ma_{k}") * F.col(f"n_{k}"), 4).alias(f"sum_{k}") for k in _SHORT]
    )


@query(f"{_WEEKS} SELECT symbol, week_end, {S.POSITION} AS bars_before, {S.AGE} AS age FROM weeks")
def bar_position(spark, sf_dir):
    return _usable(spark, sf_dir).select(
        "symbol", "week_end", T.bar_position().alias("bars_before"), T.bar_age().alias("age")
    )


@query(f"{_WEEKS} SELECT symbol, week_end, round(volume / ({S.mean('volume', 52)}), 6) AS volume_ratio FROM weeks")
def volume_ratio(spark, sf_dir):
    return (
        _usable(spark, sf_dir)
        .select("symbol", "week_end", "volume", T.avg_volume(52, **_PREFIX).alias("avg_volume"))
        .select("symbol", "week_end", F.round(T.volume_ratio(), 6).alias("volume_ratio"))
    )


@query(f"{_WEEKS} SELECT symbol, week_end, round({S.mean('close', 4, 1.0)}, 6) AS recent_mean FROM weeks")
def preceding_mean(spark, sf_dir):
    return _usable(spark, sf_dir).select(
        "symbol", "week_end", F.round(T.preceding_mean("close", 4, **_PREFIX), 6).alias("recent_mean")
    )


_FEATURES = f"{_WEEKS}, {S.features(B.SHORT)}"


def _features(spark, sf_dir):
    return _usable(spark, sf_dir).select(
        "symbol",
        "week_end",
        "close",
        "volume",
        T.bar_position().alias("bars_before"),
        T.avg_volume(B.SHORT.avg_volume_weeks, **_PREFIX).alias("avg_volume"),
        T.preceding_mean("close", B.SHORT.price_avg_weeks, **_PREFIX).alias("recent_mean"),
        *T.moving_averages(_SHORT, **_PREFIX),
    )


@query(f"{_FEATURES} SELECT symbol, week_end, volume FROM features WHERE {S.spike(B.SHORT)}")
def volume_spikes(spark, sf_dir):
    spikes = _features(spark, sf_dir).filter(P.volume_spike(B.SHORT.volume_multiplier))
    return spikes.select("symbol", "week_end", "volume")


@query(f"""{_FEATURES} SELECT symbol, week_end, "close" FROM features WHERE {S.rising(B.SHORT)}""")
def price_momentum(spark, sf_dir):
    rising = _features(spark, sf_dir).filter(P.price_above_recent(B.SHORT.price_avg_weeks, False))
    return rising.select("symbol", "week_end", "close")


@query(
    f"""{_WEEKS}, {S.features(B.DEFAULT)} SELECT symbol, week_end, {", ".join(
        f"{S.state(k, n)} AS state_{k}" for k, n in _PERIODS.items())} FROM features"""
)
def ma_states(spark, sf_dir):
    return _usable(spark, sf_dir).select("symbol", "week_end", *P.ma_states(_PERIODS, **_PREFIX))


@query(f"{_FEATURES} SELECT symbol, week_end FROM features WHERE {S.above(B.SHORT)}")
def all_averages_hold(spark, sf_dir):
    states = [P.ma_state(n, f"ma_{k}") for k, n in _SHORT.items()]
    return _features(spark, sf_dir).filter(P.all_ma_hold(states)).select("symbol", "week_end")


@query(
    f"""{_FEATURES} SELECT symbol, week_end, {", ".join(
        f"{S.gate(B.SHORT, d)} AS old_enough_{d}" for d in S.GATES)} FROM features"""
)
def history_gate(spark, sf_dir):
    def gate(extra, intermediate):
        c = B.SHORT
        return P.old_enough(
            c.ma_short, c.ma_intermediate, c.avg_volume_weeks, extra_weeks=extra, gate_intermediate=intermediate
        )

    return _features(spark, sf_dir).select(
        "symbol",
        "week_end",
        gate(0, True).alias("old_enough_live"),
        gate(0, False).alias("old_enough_snapshot"),
        gate(1, False).alias("old_enough_lookback"),
    )


@query(
    f"""{S.with_(S.SUPPLIER_INFO)} SELECT symbol, market_cap, {S.cap(B.CAPPED)} AS between_bounds,
    {S.cap(B.NEWEST)} AS below_top, {S.cap(B.SHORT)} AS unbounded FROM info"""
)
def cap_filter(spark, sf_dir):
    def inside(c):
        return P.market_cap_between(c.min_market_cap, c.max_market_cap)

    return B.supplier_info(spark, sf_dir).select(
        "symbol",
        "market_cap",
        inside(B.CAPPED).alias("between_bounds"),
        inside(B.NEWEST).alias("below_top"),
        inside(B.SHORT).alias("unbounded"),
    )


@query(
    f"""{_WEEKS}, {S.LISTED_INFO} SELECT symbol, week_end, "close", market_cap
    FROM weeks LEFT JOIN info USING (symbol)""",
    name="attach_info",
)
def attach_info_query(spark, sf_dir):
    return attach_info(
        _usable(spark, sf_dir).select("symbol", "week_end", "close"), B.listed_info(spark, sf_dir), "left"
    )
