import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barscreen.functions import predicates as P
from barscreen.functions import trailing as T


@pytest.mark.parametrize("method", ["prefix", "frames"])
def test_trailing_mean_equals_rolling(spark, method):
    rng = np.random.default_rng(3)
    frames = []
    for k in range(5):
        n = int(rng.integers(1, 120))
        close = np.round(rng.lognormal(1, 2, n), 4)
        close[rng.random(n) < 0.2] = np.nan
        frames.append(pd.DataFrame({"symbol": f"S{k}", "week_end": pd.date_range("2020-01-06", periods=n, freq="7D").date, "close": close}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf, "symbol string, week_end date, close double").withColumn("close", F.nanvl("close", F.lit(None)))
    periods = (1, 2, 9, 52, 200)
    got = T.scaled(df, ("close",)).select("symbol", "week_end", *[T.trailing_mean("close", n, method=method).alias(f"m{n}") for n in periods])
    got = got.toPandas().sort_values(["symbol", "week_end"]).reset_index(drop=True)
    for n in periods:
        want = pdf.groupby("symbol").close.transform(lambda s: s.shift(1).rolling(n, min_periods=int(n * 0.8)).mean())
        np.testing.assert_allclose(got[f"m{n}"].to_numpy(float), want.to_numpy(float), rtol=1e-9)


def test_means_of_infinite_values_and_of_all_sizes(weekly_of):
    inf = float("inf")
    closes = {
        "UP": [1.0, inf, 2.0, 3.0, 4.0, 5.0], "DOWN": [1.0, -inf, 2.0, 3.0, 4.0, 5.0], "BOTH": [inf, 2.0, -inf, 3.0, 4.0, 5.0],
        "LARGE": [999_999_999_999.0, 0.001, 5.5, 1e11, 7.25, 0.5], "LARGER": [1e12, 3e12, 0.25, 1e-3, 2e12, 5e11], "SMALL": [9e-4, 1e-3, 2e-9, 0.5, 1.0, 3.0],
        "ZERO": [0.0, 0.0, 0.0, 1.0, 2.0, 3.0], "MINUS": [-1.5, 2.5, -1e-5, 3e5, -7.0, 1.0],
    }
    weekly = T.scaled(weekly_of({k: (v, [1] * len(v)) for k, v in closes.items()}))
    both = [T.trailing_mean("close", n, 0.0, method=m).alias(f"{m}{n}") for n in (2, 3, 5) for m in ("prefix", "frames")]
    for r in weekly.select("symbol", *both).collect():
        for n in (2, 3, 5):
            one, two = r[f"prefix{n}"], r[f"frames{n}"]
            assert (one is None and two is None) or one == pytest.approx(two, rel=1e-12, abs=1e-15, nan_ok=True), (r["symbol"], n)


@pytest.mark.parametrize("method", ["prefix", "frames"])
@pytest.mark.parametrize("price", [0.1, 0.001, 1234.56, 33.33, 0.0009, 7e12, 999_999_999_999.9, 1e-300])
def test_mean_of_equal_prices_is_that_price(weekly_of, method, price):
    weekly = T.scaled(weekly_of({"A": ([price] * 60, [1] * 60)}))
    means = weekly.select(*[T.trailing_mean("close", n, method=method).alias(f"m{n}") for n in (3, 7, 49)])
    for name in means.columns:
        assert {r[0] for r in means.select(name).collect()} <= {None, price}


def test_tie_with_the_mean_is_exact(weekly_of):
    """1.1 and 1.3 average to 1.2 however long the history: not strictly above."""
    closes = [1.1, 1.3] * 40 + [1.2]
    weekly = T.scaled(weekly_of({"A": (closes, [1] * 81)}))
    last = weekly.select("week_end", "close", T.trailing_mean("close", 80, method="prefix").alias("m"))
    row = last.orderBy(F.desc("week_end")).first()
    assert row.m == row.close == 1.2


@pytest.mark.parametrize("price", [3.6e-20, 1.23456789012345e-10, 0.1, 7e14, 2.5e300])
def test_equal_prices_have_that_price_as_mean(weekly_of, price):
    weekly = T.scaled(weekly_of({"A": ([price] * 60, [2e14] * 60), "B": ([1.0] * 5, [0] * 5)}))
    means = weekly.where("symbol = 'A'").select(
        "week_end", T.trailing_mean("close", 40, method="prefix").alias("c"), T.trailing_mean("volume", 7, method="prefix").alias("v")
    )
    rows = means.orderBy("week_end").collect()[40:]
    assert {(r["c"], r["v"]) for r in rows} == {(price, 2e14)}


def test_infinite_values_give_infinite_means(weekly_of):
    weekly = T.scaled(weekly_of({"A": ([1.0, float("inf"), 2.0, 3.0, 4.0], [1] * 5)}))
    got = [r[0] for r in weekly.select("week_end", T.trailing_mean("close", 1, method="prefix").alias("m")).orderBy("week_end").select("m").collect()]
    assert got == [None, 1.0, float("inf"), 2.0, 3.0]


def test_frames_count_rows_not_calendar_weeks(bars_of):
    rows = [("A", d, float(i), 1) for i, d in enumerate(("2024-01-01", "2024-01-08", "2024-02-05", "2024-02-12"))]
    weekly = bars_of(rows).withColumnRenamed("session_date", "week_end")
    means = weekly.select("week_end", T.preceding_mean("close", 3).alias("m"), T.bar_position().alias("b"), T.bar_age().alias("a"))
    got = means.orderBy("week_end").collect()
    assert [r.m for r in got] == [None, None, None, 1.0]
    assert [r.b for r in got] == [0, 1, 2, 3] and [r.a for r in got] == [4, 3, 2, 1]


def value(spark, column, **cells):
    df = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in cells.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "cap, low, high, passes",
    [
        (None, 0, 100, True), (None, 1, 0, False), (None, 0, 0, True),
        (5e6, 5, 10, True), (10e6, 5, 10, True), (4.99e6, 5, 10, False), (10.01e6, 5, 10, False),
        (1e12, 5, 0, True), (1.0, 0, 10, True),
    ],
)
def test_market_cap_bounds(spark, cap, low, high, passes):
    assert value(spark, P.market_cap_between(low, high), market_cap=(cap, "double")) is passes


def test_volume_spike_is_inclusive(spark):
    def spike(volume, average, mult=2.0):
        return value(spark, P.volume_spike(mult), volume=(volume, "double"), avg_volume=(average, "double"))

    assert spike(20, 10) is True and spike(19.999, 10) is False
    assert spike(20, None) is False and spike(20, 0) is False


def test_price_momentum_is_strict(spark):
    def above(close, mean, before, weeks, zero=False):
        return value(
            spark, P.price_above_recent(weeks, zero),
            close=(close, "double"), recent_mean=(mean, "double"), bars_before=(before, "int"),
        )

    assert above(2, 1, 1, 1) is True and above(1, 1, 1, 1) is False
    assert above(2, 1, 1, 2) is False and above(2, None, 5, 1) is False
    assert above(2, None, 5, 0, zero=True) is True and above(2, None, 5, 0) is False


def test_ma_state(spark):
    def state(close, mean, before, n=5):
        return value(spark, P.ma_state(n, "m"), close=(close, "double"), m=(mean, "double"), bars_before=(before, "int"))

    assert [state(2, 1, 4), state(2, 1, 5), state(1, 1, 5), state(2, None, 5)] == ["omitted", "pass", "fail", "fail"]


def test_volume_ratio(spark):
    def ratio(v, a):
        return value(spark, T.volume_ratio(), volume=(v, "double"), avg_volume=(a, "double"))

    assert ratio(3, 2) == 1.5 and ratio(3, 0) == float("inf") and ratio(3, None) is None
