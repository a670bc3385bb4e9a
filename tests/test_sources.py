import json
from datetime import date

import pytest
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.session import scratch_path
from tests.conftest import BAR_SCHEMA


def symbols(df):
    return [r.symbol for r in df.collect()]


LIST = "Symbol|Security Name\nAAA|Aaa Inc\n bbb \nCCC.AX\n\t\n\n# x\n  # y\n|empty\nbbb\nSymbol\n"


def test_list_modes(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(LIST)
    assert symbols(bs.read_symbols(spark, str(path), "fetch", ".AX")) == ["AAA.AX", "BBB.AX", "CCC.AX", "BBB.AX"]
    assert symbols(bs.read_symbols(spark, str(path), "scan", ".AX")) == ["AAA", "BBB.AX", "CCC.AX", "BBB.AX", "SYMBOL.AX"]
    assert symbols(bs.read_symbols(spark, str(path))) == ["AAA", "BBB", "CCC.AX", "BBB"]
    assert sorted(symbols(bs.distinct_symbols(bs.read_symbols(spark, str(path))))) == ["AAA", "BBB", "CCC.AX"]


def test_header_position(spark, tmp_path):
    """fetch looks at the first line only, scan at the first that matches; one each."""
    path = tmp_path / "list.txt"
    path.write_text("aaa\nX Symbol|Security Name\nY Symbol|Security Name\n")
    assert symbols(bs.read_symbols(spark, str(path), "fetch")) == ["AAA", "X SYMBOL", "Y SYMBOL"]
    assert symbols(bs.read_symbols(spark, str(path), "scan")) == ["AAA", "Y SYMBOL"]
    path = tmp_path / "other.txt"
    path.write_text("My Symbol, Security Name\r\nbbb\r\n")
    assert symbols(bs.read_symbols(spark, str(path), "fetch")) == ["BBB"]


def test_list_roundtrip(spark):
    path = scratch_path(spark, "list")
    rows = spark.createDataFrame([("A,B",), ('Q"T',), ("C.AX",)], "symbol string")
    bs.write_symbols(rows.repartition(2), path)
    assert sorted(symbols(bs.read_symbols(spark, path))) == ["A,B", "C.AX", 'Q"T']


def test_symbols_from_table(spark):
    df = spark.createDataFrame([("x", " cba ", 1), ("y", None, 2)], "Name string, `ASX Code` string, code2 int")
    assert symbols(bs.symbols_from_table(df)) == ["CBA"]
    with pytest.raises(ValueError):
        bs.symbols_from_table(df.select("Name"))


DOCUMENT = {
    "metadata": {"fetch_date_utc": "2024-05-01T12:34:56.789012+00:00", "source_ticker_file": "l.txt", "data_years_fetched": 15},
    "stocks": {
        "A": {
            "info": {"marketCap": 5000000, "regularMarketPrice": 1.5, "longName": "Aaa", "nested": {"k": [1]}},
            "history": {
                "columns": ["Adj Close", "Close", "Volume", "Open"],
                "index": ["2024-01-02T00:00:00.000", "2024-01-01T13:00:00.000Z", "2024-01-03T00:00:00.000+11:00"],
                "data": [[9.0, 2.5, 100, 2.0], [None, None, 7, None], [1.0, 3.5, 0, 3.0]],
            },
        },
        "B": {"info": {}, "history": {"columns": ["Close"], "index": ["2024-01-02T00:00:00.000"], "data": [[4.0]]}},
        "C": {"info": {"longName": "No price"}},
    },
}


def test_bundle(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(DOCUMENT, indent=2))
    snap = bs.read_snapshot(spark, str(path), exchange_tz="Australia/Sydney")
    got = {(r.symbol, str(r.session_date), r.open, r.high, r.close, r.volume) for r in snap.bars.collect()}
    assert got == {
        ("A", "2024-01-02", 2.0, None, 2.5, 100.0),
        ("A", "2024-01-02", None, None, None, 7.0),  # 13:00 UTC is past midnight in Sydney
        ("A", "2024-01-03", 3.0, None, 3.5, 0.0),
        ("B", "2024-01-02", None, None, 4.0, None),
    }
    assert {tuple(r) for r in snap.info.drop("details").collect()} == {("A", 5e6, 1.5), ("C", None, None)}
    meta = bs.snapshot_metadata(snap).first()
    assert (meta.fetched_text, meta.stock_count, meta.data_years_fetched) == ("2024-05-01 12:34 UTC", 3, 15)
    assert symbols(bs.valid_info(snap.info)) == ["A"]


def test_bundle_without_stocks_or_metadata(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text("{}")
    snap = bs.read_snapshot(spark, str(path))
    assert snap.bars.count() == 0 and snap.info.count() == 0
    assert bs.snapshot_metadata(snap).first().fetched_text == "N/A"


def test_broken_bundle_is_reported(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "bad.json").write_text('{"stocks": {"Z": ')
    snap = bs.read_snapshot(spark, str(tmp_path))
    assert snap.errors.count() == 1
    assert {r.symbol for r in snap.bars.collect()} == {"A", "B"}


def some_bars(spark):
    rows = [
        (s, date(y, 3, d), 1.0 * d, 2.0 * d, None if d == 4 else 0.1 * d, 1.1 * d, float(d)) for s in ("A", "B", "C") for y in (2022, 2023) for d in range(1, 6)
    ]
    return spark.createDataFrame(rows, BAR_SCHEMA)


@pytest.mark.parametrize("layout", ["parquet", "jsonl", "bundle"])
def test_snapshot_roundtrip(spark, info_of, layout):
    bars, info = some_bars(spark), info_of({"A": 5, "B": None})
    path = scratch_path(spark, layout)
    meta = {"fetch_date_utc": "2024-05-01T00:00:00+00:00", "source_ticker_file": "x", "data_years_fetched": 3}
    bs.write_snapshot(bars, info, meta, path, layout, symbols_per_document=2)
    snap = bs.read_snapshot(spark, path, layout)
    assert sorted(map(tuple, snap.bars.select(bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    figures = snap.info.select(*info.columns).collect()
    assert sorted(map(tuple, figures)) == sorted(map(tuple, info.collect()))
    got = bs.snapshot_metadata(snap).first()
    assert (got.stock_count, got.source_ticker_file, got.data_years_fetched) == (3, "x", 3)
    assert snap.errors.count() == 0


def test_bundle_documents_are_whole_json(spark, info_of, tmp_path):
    path = scratch_path(spark, "bundle").removeprefix("file:")
    bs.write_snapshot(some_bars(spark), info_of({"A": 5}), {"data_years_fetched": 1}, path, "bundle", symbols_per_document=1)
    import glob

    documents = [json.load(open(p)) for p in glob.glob(f"{path}/*/part-*")]
    assert sum(len(d["stocks"]) for d in documents) == 3
    a = next(d for d in documents if "A" in d["stocks"])["stocks"]["A"]
    assert a["info"] == {"marketCap": 5e6, "regularMarketPrice": 1.0}
    assert a["history"]["columns"] == ["Open", "High", "Low", "Close", "Volume"] and len(a["history"]["data"]) == 10


def test_wide_frames(spark):
    rows = [(date(2024, 1, 1), 1.0, 10.0, float("nan"), 5.0), (date(2024, 1, 2), None, None, 3.0, None)]
    wide = spark.createDataFrame(rows, "session_date date, `A.AX|Close` double, `A.AX|Volume` double, `B|Open` double, `B|Volume` double")
    bars = bs.bars_from_wide(wide)
    got = {(r.symbol, r.session_date.day): (r.open, r.close, r.volume) for r in bs.drop_empty_bars(bars).collect()}
    assert got == {("A.AX", 1): (None, 1.0, 10.0), ("B", 1): (None, None, 5.0), ("B", 2): (3.0, None, None)}
    with pytest.raises(ValueError):
        bs.bars_from_wide(wide.select("session_date"))


def test_coverage(spark, bars_of, info_of):
    listed = spark.createDataFrame([(s,) for s in "AABCDE"], "symbol string")
    bars = bars_of([("A", "2024-01-01", 1.0, 1), ("B", "2024-01-01", 1.0, 1), ("C", "2024-01-01", 1.0, 1), ("D", "2024-01-01", None, None)])
    info = info_of({"A": None, "B": 5, "D": 5}).unionByName(spark.createDataFrame([("C", 5.0, None)], "symbol string, market_cap double, regular_market_price double"))
    got = bs.coverage_report(listed, bars, info).first().asDict()
    assert got == {"symbols_requested": 6, "symbols_saved": 3, "no_history": 2, "no_info": 1, "no_market_cap": 2}
    assert sorted(symbols(bs.missing_symbols(listed, bars))) == ["D", "E"]


def test_settings(spark, tmp_path):
    path = tmp_path / "mine.json"
    path.write_text(json.dumps({"min_market_cap": 5.0, "ma_short": 10}, indent=4))
    loaded = bs.ScreenConfig.from_json(spark, str(path))
    assert loaded == bs.ScreenConfig(min_market_cap=5.0, ma_short=10)
    assert (loaded.ma_long, loaded.volume_multiplier, loaded.lookback_weeks) == (700, 2.0, 1)
    assert bs.read_settings(spark, str(path)).first().config_id == "mine"
    saved = scratch_path(spark, "settings")
    deep = bs.ScreenConfig(lookback_weeks=7)
    deep.to_json(spark, saved)
    assert bs.ScreenConfig.from_json(spark, saved) == deep


def test_settings_in_every_form_lose_no_screen(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.json").write_text('{"volume_multiplier": 3.0}')
    (tmp_path / "lines.json").write_text('{"ma_short": 1}\n\n{"ma_short": 2}\n{"ma_short": 3, "config_id": "own"}\n')
    (tmp_path / "list.json").write_text('[\n{"ma_long": 5},\n{"ma_long": 6}\n]')
    (tmp_path / "pretty.json").write_text('{\n  "ma_long": 7\n}')
    paths = [str(tmp_path / x) for x in ("a", "b", "lines.json", "list.json", "pretty.json")]
    rows = {r["config_id"]: r for r in bs.read_settings(spark, paths).collect()}
    assert len(rows) == 8 and {"own", "lines#0", "lines#1", "list#0", "list#1", "pretty"} < set(rows)
    assert sorted(k.rsplit("/", 2)[-2:] for k in rows if "same" in k) == [["a", "same"], ["b", "same"]]
    assert rows["lines#1"]["ma_short"] == 2 and rows["list#1"]["ma_long"] == 6 and rows["pretty"]["ma_long"] == 7
    (tmp_path / "broken.json").write_text("{oops")
    with pytest.raises(Exception, match="not a settings file"):
        bs.read_settings(spark, str(tmp_path / "broken.json")).collect()


def test_two_screens_of_one_id_are_refused(spark, weekly_of, info_of):
    from barscreen.config import settings_frame

    frame = settings_frame(spark, {"a": bs.ScreenConfig()})
    with pytest.raises(ValueError, match="several screens are named"):
        bs.screen_many(weekly_of({"A": ([1.0] * 9, [1] * 9)}), info_of({"A": 1}), frame.union(frame))


class Session:
    """As much of a session as choosing a folder needs."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_scratch_follows_the_session():
    shared = Session(spark_master="yarn", spark_checkpoint_dir="hdfs://shared/dir/")
    assert scratch_path(shared, "x").startswith("hdfs://shared/dir/barscreen-")
    assert scratch_path(shared, "x") != scratch_path(shared, "x")
    assert scratch_path(Session(spark_master="local[2]"), "x").endswith("/x")
    with pytest.raises(ValueError):
        scratch_path(Session(spark_master="yarn"), "x")


def test_a_damaged_stock_of_a_bundle_is_named(spark, tmp_path):
    good = '{"info": {"marketCap": 1, "sector": "Tech"}, "history": {"columns": ["Close"], "index": ["2024-01-02"], "data": [[1.0]]}}'
    text = '{"metadata": {"fetch_date_utc": "2024-01-03"}, "stocks": {"GOOD": %s, "BAD": {"info": 7, "history": "none"}}}' % good
    (tmp_path / "one.json").write_text(text)
    snap = bs.read_snapshot(spark, str(tmp_path / "one.json"), "bundle")
    assert [r.symbol for r in snap.errors.collect()] == ["BAD"]
    assert [(r.symbol, r.market_cap, r.details) for r in snap.info.collect()] == [("GOOD", 1.0, {"sector": "Tech"})]
    assert snap.bars.count() == 1


def test_one_bar_a_day_in_a_table(spark):
    rows = [("A", date(2024, 1, 2), 1.0, 1), ("A", date(2024, 1, 2), 2.0, 3), ("A", date(2024, 1, 2), 5.0, 2), ("B", date(2024, 1, 2), 4.0, 1)]
    bars = spark.createDataFrame(rows, "symbol string, session_date date, close double, ts int")
    assert sorted((r.symbol, r.close) for r in bs.dedupe_bars(bars).collect()) == [("A", 2.0), ("B", 4.0)]


def test_a_document_is_written_an_entry_a_line(spark, tmp_path, bars_of, info_of):
    bars = bars_of([(f"S{i}", "2024-01-02", 1.0 + i, 5) for i in range(30)])
    bs.write_snapshot(bars, info_of({"S1": 7}), {"data_years_fetched": 1}, str(tmp_path / "s"), "bundle", symbols_per_document=1 << 40)
    [path] = (tmp_path / "s").glob("*/part-*")
    lines = path.read_text().splitlines()
    assert len(lines) == 31 and len(json.loads("".join(lines))["stocks"]) == 30
    for layout in ("bundle", "document"):
        snap = bs.read_snapshot(spark, str(tmp_path / "s"), layout)
        assert snap.bars.count() == 30 and snap.info.count() == 1 and snap.metadata.first()["stock_count"] == 30


def test_info_alone_is_read_without_histories(spark, tmp_path, bars_of, info_of):
    bs.write_snapshot(bars_of([("A", "2024-01-02", 1.0, 5)]), info_of({"A": 7}), {}, str(tmp_path / "s"), "jsonl")
    info = bs.read_snapshot(spark, str(tmp_path / "s"), "jsonl").info
    plan = info._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert info.count() == 1 and not [step for step in plan if "Aggregate" in step and "history" in step]


def _steps(df, name):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if name in line]


def test_bars_are_shuffled_once_to_their_documents(spark, bars_of, info_of):
    from barscreen.sources.snapshot import _dealt_records

    bars = bars_of([("A", "2024-01-03", 1.0, 5), ("A", "2024-01-02", 2.0, 7), ("A", "2024-01-02", 2.0, 1), ("B", "2024-01-02", 3.0, None)])
    records = _dealt_records(bars, info_of({"A": 7, "OTHER": 1}), 3)
    assert records.rdd.getNumPartitions() == 3
    plan = records._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r["symbol"]: (r["info"].toJson() if hasattr(r["info"], "toJson") else str(r["info"]), r["history"]["index"], r["history"]["data"]) for r in records.collect()}
    assert set(got) == {"A", "B"} and '"marketCap":7000000' in got["A"][0].replace(".0", "") and got["B"][0] == "{}"
    assert got["A"][1] == ["2024-01-02T00:00:00.000", "2024-01-03T00:00:00.000"] and got["A"][2][0] == [2.0, 2.0, 2.0, 2.0, 8.0]
    with pytest.raises(Exception, match="names each symbol once"):
        _dealt_records(bars, info_of({"A": 7}).unionByName(info_of({"A": 7})), 3).collect()


def test_the_newest_record_is_found_without_shuffling_histories(spark, tmp_path):
    stock = lambda c: {"info": {}, "history": {"columns": ["Close"], "index": ["2024-01-02"], "data": [[c]]}}
    for name, day, stocks in (("a", "2024-01-05", {"A": stock(1.0), "B": stock(1.0), "C": {"info": 7, "history": "none"}}), ("b", "2024-01-04", {"A": stock(2.0), "C": stock(2.0)}), ("c", None, {"D": stock(3.0)})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"metadata": {"fetch_date_utc": day}, "stocks": stocks}))
    for layout in ("bundle", "document"):
        snap = bs.read_snapshot(spark, str(tmp_path), layout)
        assert {(r.symbol, r.close) for r in snap.bars.collect()} == {("A", 1.0), ("B", 1.0), ("C", 2.0), ("D", 3.0)}
        assert snap.bars.count() == 4 and not [step for step in _steps(snap.bars, "Aggregate") if "history" in step]
