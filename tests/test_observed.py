"""Counts from the run itself, rejected rows, and frames of very many columns."""

import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.session import scratch_path

from .test_versions import CONFIG, WEEKLY, weeks_of


@pytest.mark.parametrize("dialect, as_of", [("lookback", None), ("snapshot", "2021-02-15"), ("live", "2021-03-01")])
def test_a_run_counts_what_the_summary_counts(spark, info_of, dialect, as_of):
    rows = weeks_of(60, "A") + weeks_of(60, "UP", price=lambda k: 1.0 + k, volume=lambda k: 1.0 + k * k) + weeks_of(4, "YOUNG")
    rows += weeks_of(60, "RISE", price=lambda k: 2.0 + k, volume=lambda k: 5.0 + k * k) + weeks_of(9, "EMPTY", volume=lambda k: 0.0)
    weekly, info = spark.createDataFrame(rows, WEEKLY), info_of({"A": 5, "UP": 7, "YOUNG": None})
    listed = spark.createDataFrame([(s,) for s in ("A", "UP", "UP", "RISE", "NOWHERE")], "symbol string")
    names = ["ticker", "date", "close_price", "market_cap", "avg_volume", "volume_ratio"]
    for symbols in (None, listed):
        for config in (CONFIG,) if symbols is None else (bs.ScreenConfig(**{**CONFIG.__dict__, "max_market_cap": 6.0}),):
            path = scratch_path(spark, "records")
            records, seen = bs.observed_screen(weekly, info, config, dialect, as_of, symbols)
            records.write.parquet(path)
            summary = bs.screen_summary(bs.explain_screen(weekly, info, config, dialect, as_of, symbols)).first()
            assert seen.get == {"matched": summary["matched"], "total": summary["total"]}
            want = bs.screen(weekly, info, config, dialect, as_of, symbols and symbols.distinct())
            assert {tuple(r) for r in spark.read.parquet(path).select(names).collect()} == {tuple(r) for r in want.select(names).collect()}
    assert seen.get["total"] == 4


def test_a_run_that_counts_reads_the_weeks_once(spark, info_of):
    path = scratch_path(spark, "weekly")
    spark.createDataFrame(weeks_of(60), WEEKLY).write.parquet(path)
    records, _ = bs.observed_screen(spark.read.parquet(path), info_of({"A": 1}), CONFIG)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CollectMetrics" in plan


def test_rows_that_are_no_bars_are_stored_beside_them(spark, info_of):
    rows = [
        ("A", "2024-01-02", "1.5", "10"), ("A", "2024-01-03", " 2 ", ""), ("A", "2024-01-04 10:30:00", "NaN", "3"), (None, "2024-01-02", "1", "1"),
        (" ", "2024-01-02", "1", "1"), ("B", "soon", "1", "1"), ("B", None, "1", "1"), ("B", "2024-01-02", "n/a", "1"), ("B", "2024-01-02", "1", "1,000"),
        ("B", "2024-01-02", None, None), ("B", "2024-01-02", "NaN", " "), ("C", "2024-01-05", "1e3", "-2"),
    ]
    table = spark.createDataFrame(rows, "code string, day string, price string, `some volume` string")
    checked = bs.checked_bars(table, "code", "day", "price", F.col("some volume"))
    assert checked.count() == len(rows)
    path = scratch_path(spark, "checked")
    bs.save_bars(checked, path)
    bars, rejected = bs.read_bars(spark, path)
    assert {(r.symbol, str(r.session_date), r.close, r.volume) for r in bars.collect()} == {
        ("A", "2024-01-02", 1.5, 10.0), ("A", "2024-01-03", 2.0, None), ("A", "2024-01-04", None, 3.0), ("C", "2024-01-05", 1000.0, -2.0)}
    found = rejected.collect()
    assert sorted((r.symbol or "", r.reason) for r in found) == [
        ("", "no symbol"), ("", "no symbol"), ("B", "close is no number"), ("B", "no date"), ("B", "no date"), ("B", "no figures"), ("B", "no figures"), ("B", "volume is no number")]
    assert any('"price":"n/a"' in r.given for r in found)
    path = scratch_path(spark, "snapshot")
    bs.write_snapshot(checked, info_of({"A": 1}), {"data_years_fetched": 1}, path, "parquet")
    snap = bs.read_snapshot(spark, path, "parquet")
    assert snap.errors.count() == 8 and snap.bars.count() == 4 and snap.metadata.first()["stock_count"] == 2
    assert {r.message.split(":")[0] for r in snap.errors.where("symbol = 'B'").collect()} == {"close is no number", "no date", "no figures", "volume is no number"}
    named = bs.checked_bars(table, "code", "day", "price", F.lit(1), open="price").where("reason like 'open%'").count()
    assert named == 0  # the close, the same cell, comes first


def test_a_frame_of_twenty_thousand_columns_is_planned_in_seconds(spark):
    fields = ("Open", "High", "Low", "Close", "Volume")
    symbols = [f"S{k}" for k in range(4000)]
    cells = [f"CAST(id + {k * 5 + j} AS DOUBLE) AS `{s}|{f}`" for k, s in enumerate(symbols) for j, f in enumerate(fields)]
    path = scratch_path(spark, "wide")
    spark.range(3).selectExpr("date_add(DATE'2024-01-01', CAST(id AS INT)) AS session_date", *cells[:500]).write.parquet(path)
    wide = spark.range(3).selectExpr("date_add(DATE'2024-01-01', CAST(id AS INT)) AS session_date", *cells)
    start = time.time()
    bars = bs.bars_from_wide(wide)
    plan = bars._jdf.queryExecution().analyzed().toString()
    assert time.time() - start < 30 and plan.count("Generate") == 1
    few = bs.bars_from_wide(spark.read.parquet(path).drop("S3|High"))
    rows = {(r.symbol, r.session_date): (r.open, r.high, r.low, r.close, r.volume) for r in few.collect()}
    assert len(rows) == 300
    for k in (0, 3, 99):
        want = [float(1 + 5 * k + j) for j in range(5)]
        assert rows[f"S{k}", date(2024, 1, 1) + timedelta(days=1)] == (want[0], None if k == 3 else want[1], *want[2:])
