"""Tables in versions, renewed snapshots, histories and keyed streams."""

import json
import shutil
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.config import settings_frame
from barscreen.session import scratch_path
from barscreen.streaming.jobs import stream_to_table

from .conftest import BAR_SCHEMA

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "symbol string, n int")


def newest(old, new):
    return old.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new)


def held(table, **how):
    found = table.read(**how)
    return sorted((r["symbol"], r["n"]) for r in found.collect()) if found is not None else []


def test_replaced_buckets_alone_are_written(spark):
    path = scratch_path(spark, "keyed")
    table = bs.KeyedTable(spark, path, buckets=8)
    assert table.versions() == [] and table.read() is None
    table.replace(rows_of(spark, [(f"S{i}", i) for i in range(60)]), newest)
    before = table.manifest()[1]["entries"]
    assert table.replace(rows_of(spark, [("S7", 700), ("S7", 701)]), newest) == 2
    after = table.manifest()[1]["entries"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert held(table) == sorted([(f"S{i}", i) for i in range(60) if i != 7] + [("S7", 700), ("S7", 701)])
    # the old version stays as it was, until it is forgotten
    assert held(table, version=1) == sorted((f"S{i}", i) for i in range(60))
    table.forget(2)
    assert table.versions() == [2] and len(held(table)) == 61
    with pytest.raises(ValueError):
        table.forget(99)
    assert bs.KeyedTable.at(spark, path).buckets == 8
    with pytest.raises(ValueError):
        bs.KeyedTable(spark, path, buckets=4).manifest()


def test_a_batch_that_runs_again_is_added_once(spark):
    table = bs.KeyedTable(spark, scratch_path(spark, "keyed"), buckets=4)
    for batch in (0, 1, 1, 0):
        table.append(rows_of(spark, [("A", batch)]), batch)
    assert held(table) == [("A", 0), ("A", 1)]
    assert table.append(rows_of(spark, []), 2) == [] and held(table) == [("A", 0), ("A", 1)]


def test_two_hundred_batches_leave_few_folders(spark):
    table = bs.KeyedTable(spark, scratch_path(spark, "keyed"), buckets=2)
    rows = spark.range(1).select(F.lit("A").alias("symbol"), F.lit(1).alias("n")).coalesce(1)
    most = 0
    folder, touched = table.write(rows)
    data = f"{table.path}/data/folder="
    for batch in range(200):
        shutil.copytree(f"{data}{folder}", f"{data}b{batch}")  # what a batch writes, without a job
        table.change(lambda said: {**said, "schema": rows.schema.json(), "entries": {b: [*said["entries"].get(b, []), f"b{batch}"] for b in touched}})
        if table.folders_per_bucket() > 16:
            table.forget(max(1, table.compact(8) - 4))
        most = max(most, table.folders_per_bucket())
    assert most <= 17 and table.read().count() == 200 and len(table.versions()) <= 30


def test_a_compaction_that_dies_loses_nothing_and_one_beside_writers_neither(spark, monkeypatch):
    table = bs.KeyedTable(spark, scratch_path(spark, "keyed"), buckets=2)
    for k in range(6):
        table.append(rows_of(spark, [("A", k), ("B", k)]), k)
    want = held(table)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", dies)
        with pytest.raises(RuntimeError):
            table.compact(2)
    assert held(table) == want and table.folders_per_bucket() == 6
    # a writer that comes in between
    publish, seen = table._publish, []

    def after_another(number, said):
        if not seen:
            seen.append(1)
            other = bs.KeyedTable(spark, table.path, buckets=2)
            other.append(rows_of(spark, [("A", 99)]), 6)
        return publish(number, said)

    monkeypatch.setattr(table, "_publish", after_another)
    table.compact(2)
    assert held(table) == sorted([*want, ("A", 99)]) and table.folders_per_bucket() == 2


def test_writers_of_one_version_do_not_overwrite_each_other(spark):
    path = scratch_path(spark, "keyed")
    tables = [bs.KeyedTable(spark, path, buckets=2) for _ in range(4)]
    folder, _ = tables[0].write(rows_of(spark, [("A", 1)]))

    def add(table, name):
        table.change(lambda said: {**said, "notes": {**said["notes"], name: True}})

    threads = [threading.Thread(target=add, args=(t, f"w{k}")) for k, t in enumerate(tables)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert set(tables[0].manifest()[1]["notes"]) == {"w0", "w1", "w2", "w3"} and tables[0].versions() == [1, 2, 3, 4]


def test_renewed_snapshot(spark):
    path = scratch_path(spark, "renewed")
    day = date(2024, 1, 2)
    bar = lambda s, c: (s, day, c, c, c, c, 1.0)
    known = "symbol string, market_cap double, regular_market_price double, details map<string,string>"

    def fetch(when, bars, info):
        meta = {"fetch_date_utc": when, "source_ticker_file": "x", "data_years_fetched": 3}
        return bs.renew_snapshot(spark.createDataFrame(bars, BAR_SCHEMA), spark.createDataFrame(info, known), meta, path, buckets=4)

    assert bs.read_snapshot(spark, path, "keyed").bars.count() == 0
    fetch("2024-01-05", [bar("A", 1.0), bar("B", 1.0), bar("N", 1.0)], [("A", 5.0, 1.0, {"x": "y"}), ("ONLY", 1.0, None, None)])
    fetch("2024-01-07", [bar("A", 2.0)], [])
    version = fetch("2024-01-06", [bar("A", 3.0), bar("B", 3.0)], [("A", 9.0, 9.0, None)])
    snap = bs.read_snapshot(spark, path, "keyed")
    assert {(r.symbol, r.close) for r in snap.bars.collect()} == {("A", 2.0), ("B", 3.0), ("N", 1.0)}
    assert {(r.symbol, r.market_cap) for r in snap.info.collect()} == {("ONLY", 1.0)}  # the newest fetch of A had none
    assert bs.snapshot_metadata(snap).first()["stock_count"] == 4 and version == 3
    fetch("2024-01-07", [bar("A", 4.0)], [])  # the same fetch again: the last one counts
    assert {r.close for r in bs.read_snapshot(spark, path, "keyed").bars.where("symbol = 'A'").collect()} == {4.0}


def weeks_of(n, symbol="A", start=date(2020, 1, 6), price=lambda k: 10.0 + k % 7, volume=lambda k: 100.0 + k % 5):
    return [(symbol, start + timedelta(weeks=k), *[price(k)] * 4, volume(k)) for k in range(n)]


CONFIG = bs.ScreenConfig(volume_multiplier=1.0, price_avg_weeks=2, ma_short=3, ma_intermediate=5, ma_medium=8, ma_long=40, avg_volume_weeks=6, lookback_weeks=9)
WEEKLY = BAR_SCHEMA.replace("session_date", "week_end")


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, old)


def streamed(spark, parts, config, dialect="lookback"):
    path = scratch_path(spark, "keyed_stream")
    for part in parts:
        spark.createDataFrame(part, WEEKLY).coalesce(1).write.mode("append").parquet(f"{path}/arrived")
        stream = spark.readStream.schema(WEEKLY).parquet(f"{path}/arrived")
        query = stream_to_table(bs.stream_judged(stream, config, dialect), f"{path}/judged", f"{path}/checkpoint")
        query.awaitTermination()
    return spark.read.parquet(f"{path}/judged"), query


def test_keyed_stream_says_what_the_batch_screen_says(spark, rocksdb, info_of):
    flat = dict(price=lambda k: 0.1, volume=lambda k: 3.0)
    odd = dict(price=lambda k: (1e300, 1e-300, 7.0, float("inf"))[k % 4], volume=lambda k: (0.0, 5.0, None, 1e9)[k % 4])
    symbols = [weeks_of(60, "A"), weeks_of(50, "FLAT", **flat), weeks_of(41, "ODD", **odd), weeks_of(5, "YOUNG"), weeks_of(60, "UP", price=lambda k: 1.0 + k, volume=lambda k: 1.0 + k * k)]
    rows = [w for s in symbols for w in s]
    cuts = [date(2020, 1, 6) + timedelta(weeks=k) for k in (13, 14, 40)]
    parts = [[r for r in rows if sum(c <= r[1] for c in cuts) == k] for k in range(4)]
    parts[2] += parts[1][:3]  # delivered again
    info = info_of({"A": 5, "UP": 7, "FLAT": None})
    weekly = spark.createDataFrame(rows, WEEKLY)
    for dialect, as_of in (("lookback", None), ("live", "2021-03-01")):
        judged, _ = streamed(spark, parts, CONFIG, dialect)
        names = ["ticker", "date", "close_price", "market_cap", "avg_volume", "volume_ratio"]
        got = {tuple(r) for r in bs.standing_results(judged, info, CONFIG, dialect, as_of).select(names).collect()}
        assert got == {tuple(r) for r in bs.screen(weekly, info, CONFIG, dialect, as_of).select(names).collect()}
        assert dialect == "live" or {g[0] for g in got} >= {"UP", "A"}


def test_a_week_costs_the_same_look_ups_whatever_the_history(spark, rocksdb):
    def look_ups(length):
        rows = weeks_of(length + 1)
        _, query = streamed(spark, [rows[:-1], rows[-1:]], CONFIG)
        # the last batch has one week: its plan reads that one file, and the state store a few keys
        progress = [p for p in query.recentProgress if p["numInputRows"]][-1]
        assert progress["numInputRows"] == 1
        [operator] = progress["stateOperators"]
        return operator["customMetrics"]["rocksdbGetCount"], operator["numRowsTotal"]

    (short, _), (long, kept) = look_ups(60), look_ups(400)
    assert long == short <= 20
    assert kept <= 45  # sums beyond the longest period are removed


def test_many_weeks_at_once_cost_the_look_ups_of_one(spark, rocksdb):
    def look_ups(weeks):
        _, query = streamed(spark, [weeks_of(weeks)], CONFIG)
        [operator] = [p for p in query.recentProgress if p["numInputRows"]][-1]["stateOperators"]
        return operator["customMetrics"]["rocksdbGetCount"] + operator["customMetrics"]["rocksdbPutCount"]

    assert look_ups(1) == look_ups(120)


def test_an_index_of_screens_finds_what_each_screen_finds(spark, info_of):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(25):
        value = [rng.lognormvariate(2, 0.3) for _ in range(60)]
        rows += weeks_of(rng.choice((4, 12, 30, 60)), f"S{k}", price=lambda i: round(value[i], 2), volume=lambda i: rng.choice([None, 0.0, rng.randrange(1, 400)]) if rng.random() < 0.2 else float(rng.randrange(50, 400)))
    rows += weeks_of(40, "FLAT", price=lambda i: 0.1, volume=lambda i: 3.0)
    weekly = spark.createDataFrame([(*r[:6], None if r[6] is None else float(r[6])) for r in rows], WEEKLY)
    info = info_of({f"S{k}": k if k % 3 else None for k in range(24)})
    periods = [(2, 3, 5, 8, 13), (0, 1, 2, 3, 4), (1, 4, 9, 16, 50)]
    configs = {}
    for k in range(60):
        p, s, i, m, n = periods[k % 3]
        low = rng.choice([0.0, 3.0])
        configs[f"c{k}"] = bs.ScreenConfig(low, low + rng.choice([0.0, 9.0]), rng.choice([0.5, 1.0, 1.2, 1.2, 2.5]), p, s, i, m, n, rng.choice([3, 6]), rng.choice([1, 4, 20]))
    names = ["config_id", "ticker", "date", "close_price", "market_cap", "avg_volume", "volume_ratio"]
    for dialect, as_of in (("lookback", None), ("snapshot", "2021-02-15"), ("live", "2021-03-01")):
        got = bs.screen_indexed(weekly, info, settings_frame(spark, configs), dialect, as_of)
        want = bs.screen_many(weekly, info, configs, dialect, as_of)
        got_rows, want_rows = ({tuple(r[n] for n in names) + tuple(str(r[c]) for c in got.columns if c.startswith("ma_")) for r in df.collect()} for df in (got, want))
        assert got_rows == want_rows and got.count() == len(got_rows)
        assert got_rows or dialect == "live"
    with pytest.raises(Exception, match="several screens"):
        bs.screen_indexed(weekly, info, settings_frame(spark, configs).union(settings_frame(spark, {"c1": CONFIG})), "lookback").collect()
    assert bs.screen_indexed(weekly, info, settings_frame(spark, {"x": CONFIG}).limit(0), "lookback").count() == 0


def test_five_thousand_screens_are_one_pass_and_a_small_plan(spark, info_of):
    weekly = spark.createDataFrame(weeks_of(30), WEEKLY)
    settings = spark.range(5000).select(
        F.concat(F.lit("c"), "id").alias("config_id"), F.lit(0.0).alias("min_market_cap"), F.lit(0.0).alias("max_market_cap"),
        (F.col("id") / 1000).alias("volume_multiplier"), *[F.lit(n).alias(c) for c, n in (
            ("price_avg_weeks", 1), ("ma_short", 2), ("ma_intermediate", 3), ("ma_medium", 4), ("ma_long", 5), ("avg_volume_weeks", 6), ("lookback_weeks", 30))])
    found = bs.screen_indexed(weekly, info_of({"A": 1}), settings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000 and plan.count("Generate explode") < 8
    one = bs.screen_many(weekly, info_of({"A": 1}), {f"c{k}": bs.ScreenConfig(0, 0, k / 1000, 1, 2, 3, 4, 5, 6, 30) for k in (0, 500, 999, 1000, 1001, 1040)})
    got = {r["config_id"]: (r["date"], r["volume_ratio"]) for r in found.collect()}
    assert {r["config_id"]: (r["date"], r["volume_ratio"]) for r in one.collect()} == {k: v for k, v in got.items() if k in ("c0", "c500", "c999", "c1000", "c1001", "c1040")}
    assert len(got) > 1000


def test_manifests_are_plain_json(spark):
    table = bs.KeyedTable(spark, scratch_path(spark, "keyed"), buckets=2)
    table.append(rows_of(spark, [("A", 1)]))
    text = spark.read.text(f"{table.path}/versions/1", wholetext=True).first()["value"]
    assert json.loads(text)["buckets"] == 2


def test_a_renewal_shuffles_what_counts_and_leaves_the_rest(spark):
    table = bs.KeyedTable(spark, scratch_path(spark, "keyed"), buckets=4)
    both = lambda old, new: new.where("n >= 0").select("symbol").distinct()
    table.renew(rows_of(spark, [(f"S{i}", i) for i in range(40)] + [(None, 1)]), both)
    first = table.manifest()[1]["entries"]
    assert held(table) == sorted((f"S{i}", i) for i in range(40))
    assert table.renew(rows_of(spark, [(f"S{i}", -1) for i in range(40)]), both) == 2  # none of them counts
    assert table.manifest()[1]["entries"] == first
    table.renew(rows_of(spark, [("S3", 300), ("S3", 301), ("S4", -5), ("NEW", 7)]), both)
    assert held(table) == sorted([(f"S{i}", i) for i in range(40) if i != 3] + [("S3", 300), ("S3", 301), ("NEW", 7)])
    assert held(table, version=2) == sorted((f"S{i}", i) for i in range(40))
    # a bucket in many small files is dealt anew
    for k in range(9):
        table.append(rows_of(spark, [(f"S{i}", 1000 + k) for i in range(40)]).repartition(4), k)
    table.renew(rows_of(spark, [("S5", 5)]), both)
    [bucket] = {r["bucket"] for r in table.read().where("symbol = 'S5'").collect()}
    assert len(table.manifest()[1]["entries"][bucket]) == 2 and len(table.read([bucket]).inputFiles()) <= 4
    assert len(held(table)) == 42 + 9 * 40 - 10 + 1
