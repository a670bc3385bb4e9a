"""Shapes of the physical plans that carry over to large tables."""

import re

import pytest

import barscreen as bs
from barscreen.session import scratch_path
from catalog import REGISTRY
from catalog import bindings as B

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """As with large tables: no side is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(text):
    return re.findall(r"Exchange (\w+)\(?([^,)]*)", text)


def test_screen_plan(spark):
    weekly, info = B.supplier_weekly(spark, SMALL), B.supplier_info(spark, SMALL)
    text = plan(bs.screen_matches(weekly, info, B.SHORT, "lookback", B.AS_OF))
    kinds = [k for k, _ in exchanges(text)]
    # bars by symbol and week, weeks by symbol, info by symbol; nothing else moves
    assert kinds == ["hashpartitioning"] * 3
    assert "SortAggregate" not in text and text.count("HashAggregate") == 4
    assert "BroadcastExchange" not in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_discount" not in read and "l_tax" not in read
    # The shuffle by symbol carries four plain columns, not their decimal forms.
    below = text[text.index("Exchange hashpartitioning(symbol") :]
    assert "38,32" not in below


def test_bucketed_weeks_are_screened_where_they_lie(spark):
    weekly, info = B.supplier_weekly(spark, SMALL), B.supplier_info(spark, SMALL)
    want = bs.screen(weekly, info, B.CAPPED, "lookback", B.AS_OF).collect()
    spark.sql("DROP TABLE IF EXISTS weekly_bucketed")
    bs.save_weekly(weekly, "weekly_bucketed", 8, scratch_path(spark, "weekly"))
    stored = spark.table("weekly_bucketed")
    text = plan(bs.screen_matches(stored, info, B.SHORT, "lookback", B.AS_OF))
    assert len(exchanges(text)) == 1  # only the info moves
    assert bs.screen(stored, info, B.CAPPED, "lookback", B.AS_OF).collect() == want
    spark.sql("DROP TABLE weekly_bucketed")


def test_cap_rules_symbols_out_before_the_weekly_aggregate(spark):
    """With a list small enough to broadcast, bars of other symbols go no further than the scan."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    weekly, info = B.supplier_weekly(spark, SMALL), B.supplier_info(spark, SMALL)
    for cfg, kind in ((B.CAPPED, "LeftSemi"), (B.NEWEST, "LeftAnti")):
        text = plan(bs.screen_matches(weekly, info, cfg, "lookback", B.AS_OF))
        assert text.index(kind) > max(m.start() for m in re.finditer(r"HashAggregate\(keys=\[symbol#\d+, ", text))


def test_live_reads_only_its_years(spark):
    bars, info = B.supplier_bars(spark, SMALL), B.supplier_info(spark, SMALL)
    text = plan(bs.screen_bars(bars, info, B.NEWEST, "live", B.AS_OF))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text[text.index("l_shipdate") :]).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed


@pytest.mark.parametrize("dialect", ["live", "snapshot", "lookback"])
def test_reasons_take_one_pass(spark, dialect):
    weekly, info = B.supplier_weekly(spark, SMALL), B.supplier_info(spark, SMALL)
    text = plan(bs.explain_screen(weekly, info, B.SHORT, dialect, B.AS_OF))
    assert text.count("lineitem.parquet") == 1
    assert len(exchanges(text)) <= 3


def test_stored_bars_are_pruned_by_year(spark):
    text = plan(REGISTRY["snapshot_recent_years"][0](spark, SMALL))
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "bar_year" in filters and "1998" in filters and "2001" in filters


def test_many_screens_share_one_pass(spark):
    weekly, info = B.supplier_weekly(spark, SMALL), B.supplier_info(spark, SMALL)
    configs = {str(m): bs.ScreenConfig(volume_multiplier=m) for m in (1.0, 1.5, 2.0)}
    text = plan(bs.screen_many(weekly, info, configs, "lookback", B.AS_OF))
    assert text.count("lineitem.parquet") == 1
    assert len(exchanges(text)) <= 3


def test_wide_frames_unfold_in_place(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0)], "session_date string, `A|Close` double")
    assert exchanges(plan(bs.bars_from_wide(wide))) == []


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if not n.startswith("stream_")))
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(REGISTRY[name][0](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in text
