from datetime import date

import pytest
from pyspark.sql import functions as F

import barscreen as bs


def weeks(df):
    return {(r.symbol, str(r.week_end)): r for r in df.collect()}


def test_week_runs_tuesday_to_monday(spark):
    trades = spark.sql(
        """SELECT 'A' AS s, t, p, 1.0D AS v FROM VALUES
        (TIMESTAMP_NTZ '2024-01-01 10:00:00', 1.0D), (TIMESTAMP_NTZ '2024-01-01 15:00:00', 2.0D),
        (TIMESTAMP_NTZ '2024-01-02 09:00:00', 3.0D), (TIMESTAMP_NTZ '2024-01-08 23:59:59', 4.0D) AS x(t, p)"""
    )
    got = weeks(bs.weekly_bars(bs.bars_from_table(trades, "s", "t", "p", "v")))
    assert set(got) == {("A", "2024-01-01"), ("A", "2024-01-08")}
    assert (got["A", "2024-01-01"].open, got["A", "2024-01-01"].close) == (1.0, 2.0)
    assert (got["A", "2024-01-08"].open, got["A", "2024-01-08"].close) == (3.0, 4.0)


def test_nulls_inside_a_week(bars_of):
    got = weeks(
        bs.weekly_bars(
            bars_of(
                [
                    ("A", "2024-01-02", None, 5),
                    ("A", "2024-01-03", 3.0, None),
                    ("A", "2024-01-04", 9.0, 2),
                    ("A", "2024-01-05", 4.0, 1),
                    ("A", "2024-01-08", None, 4),
                    ("B", "2024-01-02", None, None),
                ]
            )
        )
    )
    a, b = got["A", "2024-01-08"], got["B", "2024-01-08"]
    assert (a.open, a.high, a.low, a.close, a.volume) == (3.0, 9.0, 3.0, 4.0, 12.0)
    assert (b.close, b.volume) == (None, 0.0)


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([("A", date(2024, 1, 2), float("nan"), float("nan"))], "s string, d date, p double, v double")
    bar = bs.bars_from_table(rows, "s", "d", "p", "v").first()
    assert bar.close is None and bar.volume is None


def test_unusable_and_incomplete_weeks(bars_of):
    weekly = bs.weekly_bars(
        bars_of(
            [
                ("A", "2024-01-02", 1.0, 0),
                ("A", "2024-01-09", None, 5),
                ("A", "2024-01-16", 1.0, 5),
                ("A", "2024-01-23", 1.0, 5),
            ]
        )
    )
    usable = bs.usable_weeks(weekly)
    assert {k[1] for k in weeks(usable)} == {"2024-01-22", "2024-01-29"}
    assert {k[1] for k in weeks(bs.complete_weeks(usable, "2024-01-29"))} == {"2024-01-22", "2024-01-29"}
    assert {k[1] for k in weeks(bs.complete_weeks(usable, "2024-01-28"))} == {"2024-01-22"}


def test_recency(weekly_of):
    weekly = weekly_of({"A": ([1.0, 1.0], [1, 1])}, last="2024-01-29")
    assert bs.recent_only(weekly, "2024-02-05").count() == 2
    assert bs.recent_only(weekly, "2024-02-06").count() == 0


def test_history_range_rules(bars_of):
    bars = bars_of([("A", d, 1.0, 1) for d in ("2009-02-27", "2009-02-28", "2009-03-01", "2024-02-28", "2024-02-29")])

    def dates(**kw):
        return [str(r.session_date) for r in bs.history_range(bars, "2024-02-29", 15, **kw).orderBy("session_date").collect()]

    assert dates(rule="days") == ["2009-03-01", "2024-02-28"]
    assert dates(rule="calendar") == ["2009-02-28", "2009-03-01", "2024-02-28"]
    assert dates(rule="calendar", include_end=True)[-1] == "2024-02-29"
    with pytest.raises(ValueError):
        bs.history_range(bars, "2024-02-29", 15, rule="moon")


def test_ties_within_a_day_follow_the_tiebreak(spark):
    rows = spark.createDataFrame(
        [("A", date(2024, 1, 2), 1.0, 1.0, 7, 1), ("A", date(2024, 1, 2), 2.0, 1.0, 10, 0), ("A", date(2024, 1, 2), 3.0, 1.0, 7, 2)],
        "s string, d date, p double, v double, k long, l long",
    )
    for tiebreak in (
        [F.col("k"), F.col("l")],
        bs.packed_order(("datediff(d, DATE'0001-01-01')", 7), ("k", 3), ("l", 19)),
        bs.packed_order(("k", 2), ("l", 2)),
    ):
        week = bs.weekly_bars(bs.bars_from_table(rows, "s", "d", "p", "v", tiebreak=tiebreak)).first()
        assert (week.open, week.close) == (1.0, 2.0)


def test_packed_order_refuses_what_does_not_fit(spark):
    with pytest.raises(ValueError):
        bs.packed_order(("k", 19), ("l", 20))
    for value in (100, -1):
        df = spark.createDataFrame([(value,)], "k long").select(bs.packed_order(("k", 2)))
        with pytest.raises(Exception, match="order key part"):
            df.collect()


def test_packed_order_sorts_like_the_tuple(spark):
    values = [(a, b, c) for a in (0, 1, 10**15 - 1) for b in (0, 99) for c in (0, 7, 10**14 - 1)]
    df = spark.createDataFrame(values, "a long, b long, c long")
    got = df.orderBy(bs.packed_order(("a", 15), ("b", 2), ("c", 14))).collect()
    assert [tuple(r) for r in got] == sorted(values)


def test_a_hot_symbol_sends_only_its_weeks(spark):
    """A third of all rows in one symbol: combined before the shuffle."""
    hot = spark.range(200_000).selectExpr("'HOT' AS s", "date_add(DATE'2020-01-01', int(id % 700)) AS d", "id AS k")
    cold = spark.range(400_000).selectExpr("concat('S', id % 900) AS s", "date_add(DATE'2020-01-01', int(id % 700)) AS d", "id AS k")
    rows = hot.union(cold).selectExpr("s", "d", "k", "cast(k as double) AS p", "1.0D AS v")
    order = bs.packed_order(("datediff(d, DATE'0001-01-01')", 7), ("k", 18))
    weekly = bs.weekly_bars(bs.bars_from_table(rows, "s", "d", "p", "v", tiebreak=order))
    totals = weekly.groupBy(F.col("symbol") == "HOT").agg(F.sum("volume").alias("v"), F.count("*").alias("n")).collect()
    assert {(r[0], r.v) for r in totals} == {(True, 200_000.0), (False, 400_000.0)}
    assert next(r.n for r in totals if r[0]) <= 102
    assert "partial_max_by" in weekly._jdf.queryExecution().executedPlan().toString()
