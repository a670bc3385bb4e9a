"""Weekly bars and screens kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScreenConfig
from ..functions.cleaning import utc_date
from ..operators.weekly import ohlcv
from ..operators.records import to_rich, to_slim
from ..plans.dialects import dialect_of
from ..plans.screens import screen_matches
from ..sources.versions import KeyedTable


def stream_weekly_bars(stream: DataFrame, delay: str = "1 day", order: str | None = None) -> DataFrame:
    """Weekly bars of a stream of bars or trades, each emitted once its week is over.

    ``stream`` has ``symbol``, ``ts`` (an instant whose UTC clock shows exchange
    time, see ``utc_instant``) and OHLCV. Weeks run Tuesday to Monday; a row is
    late, and dropped, once the watermark has passed the end of its week.
    """
    week = F.window("ts", "7 days", "7 days", "5 days")
    return (
        stream.withWatermark("ts", delay)
        .groupBy("symbol", week)
        .agg(*ohlcv(order or "ts"))
        .select("symbol", F.date_sub(utc_date(F.col("window.end")), 1).alias("week_end"), *_OHLCV)
    )


_OHLCV = ("open", "high", "low", "close", "volume")


def dedupe_bars(
    bars: DataFrame, keys: tuple[str, ...] = ("symbol", "session_date"), ts: str = "ts", delay: str = "7 days"
) -> DataFrame:
    """One bar for each of ``keys``. A stream drops bars that arrive again within ``delay`` of the first time.

    A table keeps the newest bar by ``ts``, of equal times the one with the largest values.
    """
    if bars.isStreaming:
        return bars.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    rest = [c for c in bars.columns if c not in keys]
    row = F.struct(*rest)
    order = F.struct(*([ts] if ts in rest else []), *[c for c in rest if c != ts])
    return bars.groupBy(*keys).agg(F.max_by(row, order).alias("row")).select(*keys, "row.*").select(*bars.columns)


#: Buckets that a history is dealt to by symbol; a batch reads those of its symbols.
HISTORY_BUCKETS = 64
#: Folders of a bucket from which it is written anew, and versions of the history that stay readable.
MOST_FOLDERS, KEPT_VERSIONS = 16, 8


def stream_screen(
    weekly_stream: DataFrame,
    history_path: str,
    results_path: str,
    info: DataFrame,
    config: ScreenConfig,
    checkpoint: str,
    dialect: str = "lookback",
    trigger: dict | None = None,
    as_of=None,
    buckets: int = HISTORY_BUCKETS,
    most_folders: int = MOST_FOLDERS,
) -> StreamingQuery:
    """Append finished weeks to a history and screen the symbols that got any.

    The history is a ``KeyedTable``: a batch reads only the buckets of its own symbols, adds its rows under a number,
    so that running it again neither loses nor repeats rows, and rewrites buckets of more than ``most_folders`` folders.
    Others may read the history, or compact it, at any time. ``as_of`` defaults, for a dialect that needs one, to the
    newest week of the batch. Results are stored unordered; ``current_results`` reads what holds now.
    The history is read in the session of ``info``, where plans may adapt: a stream's own session doesn't let them.
    ``stream_judged`` screens without a history.
    """

    def screen_batch(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(info.sparkSession, history_path, "symbol", buckets)
        touched = table.append(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id)
        if not touched:
            return
        history = table.read(touched).drop("folder", "bucket").filter(F.col("batch_id") <= batch_id)
        new = history.filter(F.col("batch_id") == batch_id)
        affected = history.join(new.select("symbol").distinct(), "symbol", "left_semi").drop("batch_id")
        day = as_of
        if day is None and dialect_of(dialect).max_age_days is not None:
            [day] = new.agg(F.max("week_end")).first()
        found = screen_matches(affected, info, config, dialect, day)
        records = to_rich(found, config) if dialect_of(dialect).rich else to_slim(found)
        records.write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")
        if table.folders_per_bucket() > most_folders:
            table.forget(max(1, table.compact(most_folders // 2) - KEPT_VERSIONS))

    return (
        weekly_stream.writeStream.foreachBatch(screen_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_results(spark, history_path: str, results_path: str) -> DataFrame:
    """What a streaming screen says now: for each symbol the result of the last batch that brought it weeks."""
    history = KeyedTable.at(spark, history_path).read()
    if history is None:
        raise ValueError("no weeks have come yet")
    last = history.groupBy(F.col("symbol").alias("ticker")).agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(results_path).join(last, ["ticker", "batch_id"], "left_semi").drop("batch_id")


def stream_to_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a parquet table."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
