from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.functions.cleaning import utc_instant
from barscreen.session import scratch_path
from barscreen.streaming.jobs import stream_to_table

CFG = bs.ScreenConfig(
    volume_multiplier=1.05, price_avg_weeks=1, ma_short=2, ma_intermediate=3, ma_medium=4, ma_long=5, avg_volume_weeks=2,
    lookback_weeks=3,
)


def trades(spark, days=140):
    """Two bars a week for 30 symbols; volumes and closes follow from the day."""
    return spark.range(days * 30).selectExpr(
        "concat('S', id % 30) AS symbol",
        "date_add(DATE'2024-01-01', int(id div 30)) AS session_date",
        "cast(1 + (id * 7919 % 97) AS double) AS close",
        "cast(1 + (id * 104729 % 53) AS double) AS volume",
    )


def as_bars(df):
    return bs.bars_from_table(df, "symbol", "session_date", "close", "volume")


def open_stream(spark, path, per_batch=None):
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    raw = reader.parquet(path)
    return as_bars(raw).withColumn("ts", utc_instant(F.col("session_date").cast("timestamp_ntz")))


def in_months(spark, path):
    """One file per month, oldest first, as a stream would deliver them."""
    import time

    rows = trades(spark)
    for month in range(1, 6):
        part = rows.filter(F.month("session_date") == month).coalesce(1)
        part.write.mode("append").parquet(path)
        time.sleep(1.1)


@pytest.fixture(scope="module")
def delivered(spark):
    path = scratch_path(spark, "trades")
    in_months(spark, path)
    return path


@pytest.mark.parametrize("zone", ["UTC", "Australia/Sydney", "America/New_York"])
def test_stream_equals_batch_on_closed_weeks(spark, delivered, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        path = scratch_path(spark, "weekly")
        weekly = bs.stream_weekly_bars(open_stream(spark, delivered, 1), "1 day")
        stream_to_table(weekly, f"{path}/t", f"{path}/c").awaitTermination()
        got = spark.read.parquet(f"{path}/t")
        batch = bs.weekly_bars(as_bars(spark.read.parquet(delivered)))
        closed = batch.filter("week_end <= DATE'2024-05-13'")
        assert got.count() == closed.count() > 500
        assert got.exceptAll(closed.select(got.columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_late_rows_of_closed_weeks_are_dropped(spark):
    import time

    path, out = scratch_path(spark, "late"), scratch_path(spark, "out")
    rows = trades(spark, 60)
    for month in (1, 2):
        rows.filter(F.month("session_date") == month).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    late = rows.filter("session_date = DATE'2024-01-01'").withColumn("volume", F.lit(1e6))
    late.coalesce(1).write.mode("append").parquet(path)
    stream_to_table(bs.stream_weekly_bars(open_stream(spark, path, 1)), f"{out}/t", f"{out}/c").awaitTermination()
    got = spark.read.parquet(f"{out}/t")
    assert got.filter("volume >= 1e6").count() == 0
    assert got.groupBy("symbol", "week_end").count().filter("count > 1").count() == 0


def test_redelivered_bars_are_taken_once(spark):
    path, out = scratch_path(spark, "twice"), scratch_path(spark, "once")
    rows = trades(spark, 20)
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream_to_table(bs.dedupe_bars(open_stream(spark, path)), f"{out}/t", f"{out}/c").awaitTermination()
    assert spark.read.parquet(f"{out}/t").count() == rows.count()


def test_incremental_screen_batch_by_batch(spark, delivered, info_of):
    """Each batch's results are what a batch screen finds in the history so far."""
    info = info_of({f"S{i}": 10 + i for i in range(0, 30, 2)})
    base = scratch_path(spark, "job")

    def run():
        weekly = bs.stream_weekly_bars(open_stream(spark, delivered, 1))
        bs.stream_screen(weekly, f"{base}/history", f"{base}/results", info, CFG, f"{base}/checkpoint").awaitTermination()

    run()
    results = spark.read.parquet(f"{base}/results")
    batches = sorted(r[0] for r in results.select("batch_id").distinct().collect())
    assert len(batches) >= 3
    whole = bs.weekly_bars(as_bars(spark.read.parquet(delivered)))
    history = bs.KeyedTable.at(spark, f"{base}/history").read()
    for batch in batches:
        last = history.filter(F.col("batch_id") <= batch).agg(F.max("week_end")).first()[0]
        want = bs.screen(whole, info, CFG, "lookback", last)
        got = results.filter(F.col("batch_id") == batch).drop("batch_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    n = results.count()
    run()  # nothing new: nothing changes
    assert spark.read.parquet(f"{base}/results").count() == n


def test_a_batch_that_runs_again_replaces_itself(spark, delivered, info_of):
    info, base = info_of({}), scratch_path(spark, "again")

    def run(checkpoint):
        weekly = bs.stream_weekly_bars(open_stream(spark, delivered))
        bs.stream_screen(weekly, f"{base}/history", f"{base}/results", info, CFG, f"{base}/{checkpoint}").awaitTermination()
        history = bs.KeyedTable.at(spark, f"{base}/history").read().drop("folder")
        return [sorted(map(tuple, df.collect())) for df in (history, spark.read.parquet(f"{base}/results"))]

    assert run("first") == run("second")


def test_a_batch_writes_a_file_for_each_bucket(spark, delivered, info_of):
    base = scratch_path(spark, "files")
    weekly = bs.stream_weekly_bars(open_stream(spark, delivered))
    bs.stream_screen(weekly, f"{base}/history", f"{base}/results", info_of({}), CFG, f"{base}/checkpoint", buckets=2).awaitTermination()
    files = bs.KeyedTable.at(spark, f"{base}/history").read().inputFiles()
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files})
