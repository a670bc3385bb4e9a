from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

import barscreen as bs
from tests import pandas_screen

CFG = bs.ScreenConfig(
    volume_multiplier=1.1, price_avg_weeks=2, ma_short=5, ma_intermediate=8, ma_medium=13, ma_long=26,
    avg_volume_weeks=6, lookback_weeks=4,
)
AS_OF = "2024-06-26"


@pytest.fixture(scope="module")
def market():
    """Random walks with gaps, missing figures, idle weeks and stale symbols."""
    rng = np.random.default_rng(11)
    frames, caps = [], {}
    for k in range(120):
        days = pd.bdate_range(end=pd.Timestamp("2024-06-28") - pd.Timedelta(days=int(rng.choice([0, 0, 0, 9, 20]))), periods=int(rng.integers(5, 260)))
        close = np.round(10 * np.exp(np.cumsum(rng.normal(0.001, 0.03, len(days)))), 2)
        volume = np.round(rng.lognormal(6, 1, len(days)))
        close[rng.random(len(days)) < 0.1] = np.nan
        volume[rng.random(len(days)) < 0.1] = np.nan
        volume[rng.random(len(days)) < 0.15] = 0
        if k % 10 == 0:
            close[:] = 0.1
        keep = rng.random(len(days)) > 0.15
        frames.append(pd.DataFrame({"symbol": f"S{k:03d}", "session_date": days, "close": close, "volume": volume})[keep])
        if rng.random() < 0.8:
            caps[f"S{k:03d}"] = None if rng.random() < 0.2 else float(np.round(rng.uniform(1, 100), 1) * 1e6)
    return pd.concat(frames), caps


@pytest.fixture(scope="module")
def tables(spark, market):
    pdf, caps = market
    rows = pdf.assign(session_date=pdf.session_date.dt.date)
    bars = bs.bars_from_table(spark.createDataFrame(rows), "symbol", "session_date", "close", "volume")
    info = spark.createDataFrame([(s, c, 1.0) for s, c in caps.items()], "symbol string, market_cap double, regular_market_price double")
    weekly = bs.weekly_bars(bars).cache()
    return weekly, info


def found(df):
    return {r.ticker: (r.date, r.close_price, pytest.approx(r.volume_ratio, rel=1e-9)) for r in df.collect()}


@pytest.mark.parametrize("dialect", ["live", "snapshot", "lookback"])
@pytest.mark.parametrize("caps", [(0.0, 0.0), (30.0, 0.0), (0.0, 60.0), (20.0, 80.0)])
def test_agrees_with_pandas(market, tables, dialect, caps):
    cfg = replace(CFG, min_market_cap=caps[0], max_market_cap=caps[1])
    want = pandas_screen.run(*market, cfg, dialect, AS_OF)
    assert want, "the fixture should have matches"
    assert found(bs.screen(*tables, cfg, dialect, AS_OF)) == want


@pytest.mark.parametrize("dialect", ["snapshot", "lookback"])
def test_empty_price_window(market, tables, dialect):
    cfg = replace(CFG, price_avg_weeks=0)
    want = pandas_screen.run(*market, cfg, dialect, AS_OF)
    assert found(bs.screen(*tables, cfg, dialect, AS_OF)) == want
    assert bool(want) == (dialect == "snapshot")


@pytest.mark.parametrize("dialect", ["live", "snapshot", "lookback"])
def test_many_screens_equal_single_ones(tables, dialect):
    configs = {
        "a": CFG, "b": replace(CFG, volume_multiplier=1.5, ma_long=40), "c": replace(CFG, avg_volume_weeks=10, lookback_weeks=9),
        "d": replace(CFG, min_market_cap=20.0, price_avg_weeks=5),
    }
    many = bs.screen_many(*tables, configs, dialect, AS_OF).collect()
    for name, cfg in configs.items():
        single = bs.screen(*tables, cfg, dialect, AS_OF).collect()
        key = lambda r: (r.ticker, r.date, r.close_price, r.market_cap, r.avg_volume, r.volume_ratio)
        assert sorted(map(key, single)) == sorted(key(r) for r in many if r.config_id == name)


@pytest.mark.parametrize("dialect", ["live", "snapshot", "lookback"])
def test_reasons_agree_with_the_screen(tables, dialect):
    cfg = replace(CFG, min_market_cap=20.0)
    explained = {r.symbol: r.reason for r in bs.explain_screen(*tables, cfg, dialect, AS_OF).collect()}
    assert len(explained) == 120
    assert {s for s, r in explained.items() if r == "matched"} == set(found(bs.screen(*tables, cfg, dialect, AS_OF)))
    summary = bs.screen_summary(bs.explain_screen(*tables, cfg, dialect, AS_OF)).first()
    assert summary.total == 120 and summary.matched == sum(r == "matched" for r in explained.values())


def test_later_data_does_not_change_earlier_results(spark, market, tables):
    pdf, _ = market
    rows = pdf[pdf.session_date <= "2024-05-20"].assign(session_date=lambda d: d.session_date.dt.date)
    earlier = bs.weekly_bars(bs.bars_from_table(spark.createDataFrame(rows), "symbol", "session_date", "close", "volume"))
    cfg = CFG
    assert found(bs.screen(earlier, tables[1], cfg, "lookback", "2024-05-20")) == found(bs.screen(*tables, cfg, "lookback", "2024-05-20"))


def test_monotone_in_multiplier_and_lookback(tables):
    base = set(found(bs.screen(*tables, CFG, "lookback", AS_OF)))
    assert set(found(bs.screen(*tables, replace(CFG, volume_multiplier=1.6), "lookback", AS_OF))) <= base
    assert base <= set(found(bs.screen(*tables, replace(CFG, lookback_weeks=12), "lookback", AS_OF)))


# Hand-made edges. Volumes 10, spike 30; closes rise.
TINY = bs.ScreenConfig(
    volume_multiplier=2.0, price_avg_weeks=1, ma_short=2, ma_intermediate=3, ma_medium=4, ma_long=50, avg_volume_weeks=2
)


def rising(n, spikes=(1,)):
    volumes = [10.0] * n
    for age in spikes:
        volumes[-age] = 30.0
    return [float(i + 1) for i in range(n)], volumes


def test_history_needed_per_dialect(weekly_of, info_of):
    weekly = weekly_of({f"B{b}": rising(b + 1) for b in (1, 2, 3, 4)})
    info = info_of({f"B{b}": 5 for b in (1, 2, 3, 4)})
    got = {d: set(found(bs.screen(weekly, info, TINY, d, "2024-12-30"))) for d in ("live", "snapshot", "lookback")}
    assert got == {"live": {"B3", "B4"}, "snapshot": {"B2", "B3", "B4"}, "lookback": {"B3", "B4"}}


def test_info_needed_by_snapshot_only(weekly_of, info_of):
    weekly, info = weekly_of({"X": rising(9)}), info_of({"other": 5})
    got = {d: bs.screen(weekly, info, TINY, d, "2024-12-30").count() for d in ("live", "snapshot", "lookback")}
    assert got == {"live": 1, "snapshot": 0, "lookback": 1}


def test_newest_match_and_all_matches(weekly_of, info_of):
    weekly, info = weekly_of({"X": rising(12, spikes=(2, 5)), "Y": rising(12, spikes=(3,))}), info_of({})
    deep, shallow = replace(TINY, lookback_weeks=6), replace(TINY, lookback_weeks=2)
    assert {t: v[0] for t, v in found(bs.screen(weekly, info, deep, "lookback", "2024-12-30")).items()} == {"X": "2024-12-23", "Y": "2024-12-16"}
    assert set(found(bs.screen(weekly, info, shallow, "lookback", "2024-12-30"))) == {"X"}
    every = bs.matching_weeks(weekly, info, deep, "2024-12-30").collect()
    assert sorted((r.symbol, r.age) for r in every) == [("X", 2), ("X", 5), ("Y", 3)]


def test_recency_of_live(weekly_of, info_of):
    weekly, info = weekly_of({"X": rising(9)}), info_of({})
    assert bs.screen(weekly, info, TINY, "live", "2025-01-06").count() == 1
    assert bs.screen(weekly, info, TINY, "live", "2025-01-07").count() == 0
    assert bs.screen(weekly, info, TINY, "lookback", "2026-01-07").count() == 1


def test_suspended_price_is_not_above_its_average(weekly_of, info_of):
    closes, volumes = [0.1] * 30, [10.0] * 29 + [30.0]
    weekly, info = weekly_of({"X": (closes, volumes)}), info_of({"X": 1})
    cfg = replace(TINY, price_avg_weeks=0)
    assert bs.screen(weekly, info, cfg, "snapshot", "2024-12-30").count() == 0


def test_ties_are_ordered_by_symbol(weekly_of, info_of):
    weekly = weekly_of({s: rising(9) for s in ("C", "A", "B")})
    assert [r.ticker for r in bs.screen(weekly, info_of({}), TINY, "lookback", "2024-12-30").collect()] == ["A", "B", "C"]


def test_rich_record(weekly_of, info_of):
    row = bs.screen(weekly_of({"X": rising(9)}), info_of({"X": 5}), TINY, "live", "2024-12-30").first()
    assert row.ma_passes == {"short": "pass", "intermediate": "pass", "medium": "pass", "long": "omitted"}
    assert row.ma_values["short"] == 7.5 and row.ma_values["long"] is None
    assert row.ma_periods == TINY.ma_periods and row.volume == 30.0


def test_live_reports_repeats(spark, weekly_of, info_of):
    weekly, info = weekly_of({"X": rising(9), "Y": rising(9)}), info_of({})
    listed = spark.createDataFrame([("X",), ("X",), ("Z",)], "symbol string")
    assert [r.ticker for r in bs.screen(weekly, info, TINY, "live", "2024-12-30", listed).collect()] == ["X", "X"]
    assert [r.ticker for r in bs.screen(weekly, info, TINY, "lookback", "2024-12-30", listed).collect()] == ["X"]


def test_reason_steps(spark, weekly_of, info_of):
    weekly = weekly_of(
        {"young": rising(2), "midage": rising(3), "match": rising(9), "quiet": rising(9, ()), "poor": rising(9), "blank": rising(9), "idle": ([1.0], [0.0])}
    )
    info = info_of({"young": 50, "midage": 50, "match": 50, "quiet": 50, "poor": 1, "blank": None, "idle": 50, "absent": 50})
    symbols = spark.createDataFrame([(s,) for s in ("young", "midage", "match", "quiet", "poor", "blank", "idle", "absent", "bad")], "symbol string")
    errors = spark.createDataFrame([("bad", "broken")], "symbol string, message string")
    cfg = replace(TINY, min_market_cap=10.0)

    def reasons(dialect, as_of="2024-12-30"):
        return {r.symbol: r.reason for r in bs.explain_screen(weekly, info, cfg, dialect, as_of, symbols, errors).collect()}

    assert reasons("lookback") == {
        "young": "too_young_short", "midage": "too_young_short", "match": "matched", "quiet": "no_week_matched",
        "poor": "cap_below_min", "blank": "cap_missing", "idle": "no_valid_weeks", "absent": "missing_history", "bad": "error",
    }
    live = reasons("live")
    assert (live["midage"], live["poor"], live["bad"]) == ("too_young_intermediate", "cap_below_min", "error")
    assert reasons("live", "2025-02-01")["match"] == "no_recent_data"
    assert reasons("lookback", "2020-01-01")["match"] == "no_finished_weeks"


@pytest.mark.parametrize(
    "bad",
    [
        dict(min_market_cap=-1.0), dict(min_market_cap=5.0, max_market_cap=4.0), dict(ma_short=0),
        dict(ma_short=180), dict(volume_multiplier=0.0),
    ],
)
def test_live_refuses_odd_settings(weekly_of, info_of, bad):
    weekly, info = weekly_of({"X": rising(3)}), info_of({})
    cfg = replace(bs.ScreenConfig(), **bad)
    with pytest.raises(ValueError):
        bs.screen(weekly, info, cfg, "live", "2024-12-30")
    bs.screen(weekly, info, cfg, "lookback", "2024-12-30").count()


def test_required_years():
    assert bs.required_years(bs.ScreenConfig()) == pytest.approx(700 / 52 + 1 + 2)
