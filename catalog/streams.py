"""Streaming jobs, run over the given tables until they are read."""

from contextlib import contextmanager

from pyspark.sql import functions as F

import barscreen as bs
from barscreen.functions.cleaning import clean_number, packed_order, utc_instant
from barscreen.session import scratch_path
from barscreen.streaming.jobs import stream_to_table

from . import bindings as B
from . import sqltext as S
from .registry import query
from .screens import _LIVE, _RICH, flat, rounded

_EVENT_BARS = """
bars AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS session_date, row(ts, event_id) AS ord,
         value AS "open", value AS high, value AS low, value AS "close", CAST(1 AS DOUBLE) AS volume FROM events)"""


def _stream(spark, sf_dir, name):
    schema = B.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _trades(stream, symbol, ts, price, volume, order):
    number = clean_number(price)
    return stream.select(
        F.col(symbol).cast("string").alias("symbol"),
        utc_instant(F.col(ts)).alias("ts"),
        order.alias("bar_order"),
        *[number.alias(c) for c in ("open", "high", "low", "close")],
        volume.alias("volume"),
    )


def _event_order():
    micros = "date_diff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
    return packed_order((micros, 18), ("event_id", 18))


def _event_trades(stream):
    return _trades(stream, "user_id", "ts", "value", F.lit(1.0), _event_order())


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "spark.sql.streaming.stateStore"
_SETTINGS = {
    f"{_STATE}.providerClass": ROCKSDB,
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",  # else each row that is put is looked up first
}


@contextmanager
def _rocksdb(spark):
    """Streams started here keep their state beside the heap: a row for each symbol and week, however many."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _closed(table: str, ts: str) -> str:
    """Weeks that a watermark of one day behind the newest row has passed."""
    return f"CAST(week_end + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max({ts}) - INTERVAL 1 DAY FROM {table})"


@query(
    f"""{S.with_(_EVENT_BARS, S.WEEKLY)} SELECT symbol, week_end, "open", high, low, "close", volume
    FROM weekly WHERE {_closed("events", "ts")}"""
)
def stream_weekly(spark, sf_dir):
    weekly = bs.stream_weekly_bars(_event_trades(_stream(spark, sf_dir, "events")), "1 day", "bar_order")
    path = scratch_path(spark, "stream_weekly")
    with _rocksdb(spark):
        stream_to_table(weekly, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query(f"""{S.with_(_EVENT_BARS, S.DAILY)} SELECT symbol, session_date, "close", volume FROM daily""")
def stream_dedupe(spark, sf_dir):
    """Daily bars delivered twice and taken once."""
    path = scratch_path(spark, "stream_dedupe")
    daily = bs.daily_bars(
        bs.bars_from_table(
            B.table(spark, sf_dir, "events"),
            "user_id",
            "ts",
            "value",
            F.lit(1.0),
            tiebreak=_event_order(),
        )
    ).select("symbol", "session_date", "close", "volume")
    for _ in range(2):
        daily.write.mode("append").parquet(f"{path}/delivered")
    delivered = spark.readStream.schema(daily.schema).parquet(f"{path}/delivered")
    once = bs.dedupe_bars(
        delivered.withColumn("ts", utc_instant(F.col("session_date").cast("timestamp_ntz")))
    ).drop("ts")
    stream_to_table(once, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.WEEKLY,
        f"weeks AS (SELECT * FROM weekly WHERE {S.USABLE} AND {_closed('lineitem', 'l_shipdate')})",
        S.features(B.SHORT), S.SUPPLIER_INFO, S.matches(B.SHORT, "lookback"))} SELECT {S.SLIM} FROM matches"""
)
def stream_screen(spark, sf_dir):
    """Trades stream in, finished weeks are stored, their symbols are screened."""
    trades = _trades(
        _stream(spark, sf_dir, "lineitem"),
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
        F.col("l_quantity"),
        B._trade_order(),
    )
    path = scratch_path(spark, "stream_screen")
    with _rocksdb(spark):
        bs.stream_screen(
            bs.stream_weekly_bars(trades, "1 day", "bar_order"),
            f"{path}/history",
            f"{path}/results",
            B.supplier_info(spark, sf_dir),
            B.SHORT,
            f"{path}/checkpoint",
        ).awaitTermination()
    found = bs.current_results(spark, f"{path}/history", f"{path}/results")
    return found.withColumns({c: F.round(c, 6) for c in ("avg_volume", "volume_ratio")})


def _in_batches(spark, sf_dir, config, dialect, path, parts=4):
    """The rows of ``stream_judged`` over the weekly bars, which arrive in several batches by time, the last week of each again."""
    weekly = B.supplier_weekly(spark, sf_dir).where(F.col("week_end") <= B.AS_OF)
    weekly.write.parquet(f"{path}/weekly")
    weekly = spark.read.parquet(f"{path}/weekly")
    first, last = weekly.agg(F.min("week_end"), F.max("week_end")).first()
    days = ((last - first).days // 7 // parts + 1) * 7
    number = F.floor(F.datediff("week_end", F.lit(first)) / days)
    with _rocksdb(spark):
        for k in range(parts):  # what has come so far is a batch: it may be any number of files
            again = (F.datediff("week_end", F.lit(first)) == k * days - 7) & F.lit(k > 0)
            weekly.where((number == k) | again).write.mode("append").parquet(f"{path}/arrived")
            arriving = spark.readStream.schema(weekly.schema).parquet(f"{path}/arrived")
            stream_to_table(bs.stream_judged(arriving, config, dialect), f"{path}/judged", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/judged")


@query(S.screen_sql(B.SHORT, "lookback"))
def stream_screen_batches(spark, sf_dir):
    """Weeks arrive in several batches; running sums in the state store judge each without its history."""
    judged = _in_batches(spark, sf_dir, B.SHORT, "lookback", scratch_path(spark, "stream_batches"))
    return rounded(bs.standing_results(judged, B.supplier_info(spark, sf_dir), B.SHORT, "lookback"))


@query(f"{_LIVE} SELECT {_RICH} FROM matches")
def stream_screen_live(spark, sf_dir):
    """The live screen from the stream: rich records of symbols whose last week is recent."""
    judged = _in_batches(spark, sf_dir, B.NEWEST, "live", scratch_path(spark, "stream_live"))
    return flat(rounded(bs.standing_results(judged, B.supplier_info(spark, sf_dir), B.NEWEST, "live", B.AS_OF)))
