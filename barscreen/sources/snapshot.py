"""Saved market-data snapshots: bars, company info and metadata together.

Layouts: ``parquet`` (tables, partitioned by year: the one to keep data in),
``jsonl`` (one JSON record per symbol) and ``bundle`` (JSON documents, each a
map of many symbols, read by one task). ``document`` reads the same documents
in byte ranges, by many tasks: for one large document, such as a fetch of all
symbols leaves. Read it once and save as parquet. ``keyed`` is a snapshot that later
fetches renew symbol by symbol (``renew_snapshot``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.cleaning import clean_number, iso_session_date
from ..operators.weekly import daily_bars, ohlcv
from ..session import scratch_path
from .documents import document_pieces
from .versions import KeyedTable

METADATA_SCHEMA = "fetch_date_utc string, source_ticker_file string, data_years_fetched int"
HISTORY_SCHEMA = "columns array<string>, `index` array<string>, `data` array<array<double>>"
STOCK_SCHEMA = f"info map<string,string>, history struct<{HISTORY_SCHEMA}>"
RECORD_SCHEMA = f"symbol string, {STOCK_SCHEMA}, _corrupt_record string"
# Stocks are read as text first, so that a damaged one is known by name.
BUNDLE_SCHEMA = f"metadata struct<{METADATA_SCHEMA}>, stocks map<string, string>"

SYMBOLS_PER_DOCUMENT = 500


@dataclass(frozen=True)
class Snapshot:
    """``bars`` and ``info`` per symbol, one-row ``metadata``, unreadable records in ``errors``.

    Bars of the parquet layout keep ``bar_year``, the column they are stored by.
    """

    bars: DataFrame
    info: DataFrame
    metadata: DataFrame
    errors: DataFrame


def read_snapshot(spark: SparkSession, path: str, layout: str = "bundle", exchange_tz: str = "UTC") -> Snapshot:
    if layout == "parquet":
        bars, errors = _stored_bars(spark, path)
        metadata = spark.read.schema(METADATA_SCHEMA + ", stock_count long").json(f"{path}/metadata")
        return Snapshot(bars, spark.read.parquet(f"{path}/info"), metadata, errors)
    if layout == "jsonl":
        raw = spark.read.schema(RECORD_SCHEMA).json(f"{path}/stocks", mode="PERMISSIVE")
        named = F.coalesce("symbol", F.regexp_extract("_corrupt_record", r'"symbol"\s*:\s*"([^"]+)"', 1))
        errors = _damaged(raw, "info").select(
            named.alias("symbol"), F.concat(F.lit("unreadable record: "), "_corrupt_record").alias("message")
        )
        stocks = raw.filter(F.col("_corrupt_record").isNull()).select("symbol", "info", "history", F.col("_metadata.file_path").alias("newest"))
        stocks = _one_record(stocks)
        metadata = spark.read.schema(METADATA_SCHEMA + ", stock_count long").json(f"{path}/metadata")
        return Snapshot(_bars(stocks, exchange_tz), _info(stocks), metadata, errors)
    if layout == "bundle":
        raw = spark.read.schema(BUNDLE_SCHEMA + ", _corrupt_record string").json(path, multiLine=True, recursiveFileLookup=True)
        errors = _damaged(raw, "stocks").select(
            F.lit(None).cast("string").alias("symbol"),
            F.when(F.col("stocks").isNull(), F.lit("unreadable document"))
            .otherwise(F.lit("partly unreadable document"))
            .alias("message"),
        )
        fetched = raw.select("metadata.fetch_date_utc", "_metadata.file_path", F.posexplode("stocks").alias("place", "symbol", "stock"))
        newest = F.struct("fetch_date_utc", "file_path", "place").alias("newest")
        stocks, damaged = _parsed(fetched.select(newest, "symbol", "stock"))
        held = F.coalesce(F.cardinality("stocks"), F.lit(0)).cast("long")
        metadata = _counted(raw.select("metadata.*", held.alias("stock_count")))
        return Snapshot(_bars(stocks, exchange_tz), _info(stocks), metadata, errors.unionByName(damaged))
    if layout == "keyed":
        return _read_keyed(spark, path)
    if layout == "document":
        return _read_documents(spark, path, exchange_tz)
    raise ValueError(f"unknown layout {layout!r}")


def _stored_bars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bars of the parquet layout and the rows that were rejected when it was written, if it holds any."""
    bars = spark.read.parquet(f"{path}/bars")
    if "rejected" not in bars.columns:
        return bars, spark.createDataFrame([], "symbol string, message string")
    bars = bars.withColumn("rejected", F.col("rejected").cast("boolean"))  # the folder's name is read as text
    errors = bars.where("rejected").select("symbol", F.concat_ws(": ", "reason", "given").alias("message"))
    return bars.where(~F.col("rejected")).drop("rejected", "reason", "given"), errors


def _counted(documents: DataFrame) -> DataFrame:
    same = documents.groupBy("fetch_date_utc", "source_ticker_file", "data_years_fetched")
    return same.agg(F.sum("stock_count").cast("long").alias("stock_count"))


def _parsed(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stocks (symbol, newest, stock: text) as one record a symbol, and those that don't parse, by name.

    A symbol's records differ in ``newest``. Which one counts is found at once, by a pass that shuffles no histories, and
    stored: by its size Spark chooses how to join.
    """
    read = F.from_json("stock", f"{STOCK_SCHEMA}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = held.select("symbol", "newest", "stock", read.alias("s"))
    damaged = F.col("stock").isNotNull() & F.coalesce(F.col("s._corrupt_record").isNotNull(), F.lit(True))
    message = F.concat(F.lit("unreadable record: "), F.substring("stock", 1, 200)).alias("message")
    whole = parsed.filter(~damaged).select("symbol", "s.info", "s.history", "newest")
    best = whole.groupBy("symbol").agg(F.max("newest").alias("best"))
    path = scratch_path(held.sparkSession, "newest")
    best.write.parquet(path)
    best = held.sparkSession.read.schema(best.schema).parquet(path)
    stocks = whole.join(best, "symbol").where(F.col("newest").eqNullSafe(F.col("best"))).select("symbol", "info", "history")
    return stocks, parsed.filter(damaged).select("symbol", message)


#: Parts into which the entries of one document are dealt where its metadata is joined.
DEALT = 64
#: The name of an entry, as it stands before its colon.
ENTRY_NAME = r'"((?:[^"\\]|\\.)*)"\s*:'


def _read_documents(spark: SparkSession, path: str, exchange_tz: str) -> Snapshot:
    """Documents as ``bundle`` reads them, but that a damaged entry costs itself alone. The text is read at once, and kept."""
    corrupt = {"columnNameOfCorruptRecord": "_corrupt_record"}
    entries, documents = document_pieces(spark, path)
    schema = f"metadata struct<{METADATA_SCHEMA}>, stocks map<string,string>, _corrupt_record string"
    documents = documents.select("file", F.from_json("text", schema, corrupt).alias("d"))
    unread = documents.filter(F.coalesce(F.col("d._corrupt_record").isNotNull(), F.lit(True)))
    errors = unread.select(F.lit(None).cast("string").alias("symbol"), F.lit("partly unreadable document").alias("message"))
    text = F.btrim("text", F.lit(", \t\r\n"))
    object_ = F.concat(F.lit('{"s":{'), text, F.lit("}}"))
    found = entries.where(text != "").withColumn("e", F.from_json(object_, "s map<string,string>, _corrupt_record string", corrupt))
    lost = F.coalesce(F.col("e._corrupt_record").isNotNull(), F.lit(True))
    named = F.nullif(F.regexp_extract("text", ENTRY_NAME, 1), F.lit(""))
    lost_entries = found.filter(lost).select(named.alias("symbol"), F.concat(F.lit("unreadable record: "), F.substring("text", 1, 200)).alias("message"))
    # when each document was fetched decides between records of one symbol
    fetched = documents.select("file", F.col("d.metadata.fetch_date_utc").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    held = found.filter(~lost).select("file", "at", "place", F.posexplode("e.s").alias("inside", "symbol", "stock"))
    held = held.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(DEALT)).cast("int")).join(fetched, ["file", "part"], "left")
    stocks, damaged = _parsed(held.select(F.struct("day", "file", "at", "place", "inside").alias("newest"), "symbol", "stock"))
    counts = found.groupBy("file").agg(F.sum(F.when(lost, 1).otherwise(F.cardinality("e.s"))).alias("n"))
    metadata = documents.join(counts, "file", "left").select("d.metadata.*", F.coalesce("n", F.lit(0)).cast("long").alias("stock_count"))
    return Snapshot(_bars(stocks, exchange_tz), _info(stocks), _counted(metadata), errors.unionByName(lost_entries).unionByName(damaged))


def _one_record(stocks: DataFrame) -> DataFrame:
    """One record for each symbol: that of the newest fetch, of equal times the last file."""
    # two columns, not one struct: who reads one of them shuffles that one only
    return stocks.groupBy("symbol").agg(*[F.max_by(F.struct(c), "newest").alias(c) for c in ("info", "history")]).select("symbol", "info.info", "history.history")


def _damaged(raw: DataFrame, field: str) -> DataFrame:
    """Records that did not parse. Spark refuses to read their text without any
    other field, even for a count, hence the test on ``field`` that all pass."""
    held = F.when(F.col(field).isNull(), 0).otherwise(F.cardinality(field))
    return raw.filter(F.col("_corrupt_record").isNotNull() & (held >= 0))


def _bars(stocks: DataFrame, exchange_tz: str) -> DataFrame:
    """Unfold histories. Fields are found by name, once per symbol."""
    places = [F.array_position("history.columns", f).alias(f"at_{f}") for f in K.HISTORY_FIELDS]
    rows = stocks.select(
        "symbol", *places, F.explode(F.arrays_zip("history.index", "history.data")).alias("row")
    )
    cells = [
        clean_number(F.get("row.data", F.col(f"at_{f}").cast("int") - 1)).alias(name)
        for f, name in zip(K.HISTORY_FIELDS, K.OHLCV)
    ]
    return rows.select("symbol", iso_session_date(F.col("row.index"), exchange_tz).alias("session_date"), *cells)


def _info(stocks: DataFrame) -> DataFrame:
    def number(key: str) -> Column:
        return clean_number(F.try_element_at("info", F.lit(key)).try_cast("double"))

    return stocks.filter(F.cardinality("info") > 0).select(
        "symbol",
        number(K.INFO_MARKET_CAP).alias("market_cap"),
        number(K.INFO_MARKET_PRICE).alias("regular_market_price"),
        F.map_filter("info", lambda k, _: ~k.isin(K.INFO_MARKET_CAP, K.INFO_MARKET_PRICE)).alias("details"),
    )


def snapshot_metadata(snapshot: Snapshot) -> DataFrame:
    """Fetch time, source list, years and number of stocks of a snapshot."""
    fetched = F.try_to_timestamp("fetch_date_utc")
    shown = F.date_format(F.convert_timezone(None, F.lit("UTC"), fetched.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")
    return snapshot.metadata.select(
        fetched.alias("fetched_at"),
        F.coalesce(F.concat(shown, F.lit(" UTC")), F.lit("N/A")).alias("fetched_text"),
        "source_ticker_file",
        "data_years_fetched",
        "stock_count",
    )


def write_snapshot(
    bars: DataFrame,
    info: DataFrame,
    meta: dict,
    path: str,
    layout: str = "parquet",
    symbols_per_document: int = SYMBOLS_PER_DOCUMENT,
) -> None:
    """Save a snapshot. ``meta`` holds the three metadata fields.

    Bars with a ``reason`` (``checked_bars``) are rejected rows: the parquet layout stores them beside the bars, in the
    same pass, and reading it gives them as ``errors``; JSON layouts take bars only.
    The JSON layouts hold one bar per symbol and day, so the history gathered
    for a symbol is bounded by its trading days whatever the input holds. A
    bundle is written as several documents of about ``symbols_per_document``
    symbols each, so none grows with the universe. Bars, unless they are trades
    with a ``bar_order``, are shuffled once for it, to their document's task.
    """
    spark = bars.sparkSession
    if layout == "parquet":
        by_year = bars.withColumn("bar_year", F.year("session_date"))
        folders = ["bar_year"]
        if "reason" in bars.columns:
            by_year, folders = by_year.withColumn("rejected", F.col("reason").isNotNull()), ["rejected", "bar_year"]
        by_year.hint("rebalance", *folders).write.partitionBy(*folders).parquet(f"{path}/bars")
        info.write.parquet(f"{path}/info")
        held = _stored_bars(spark, path)[0].select("symbol").distinct()
        _metadata_row(held, meta).write.json(f"{path}/metadata")
        return
    if layout == "jsonl":
        stocks = _stock_records(daily_bars(bars), info)
        stocks.write.json(f"{path}/stocks")
        held = spark.read.schema("symbol string").json(f"{path}/stocks")
        _metadata_row(held, meta).write.json(f"{path}/metadata")
        return
    if layout == "bundle":
        [n_symbols] = bars.agg(F.approx_count_distinct("symbol")).first()
        documents = max(1, -(-n_symbols // symbols_per_document))
        entry = F.to_json(F.create_map("symbol", F.struct("info", "history")))
        entry = F.substr(entry, F.lit(2), F.length(entry) - 2).alias("entry")
        if symbols_per_document <= SYMBOLS_PER_DOCUMENT:
            dealt = _dealt_records(bars, info, documents).select("symbol", entry)
        else:  # too much for a task: records are put together by all, and their text goes to the document's
            shard = F.pmod(F.xxhash64("symbol"), F.lit(documents)).cast("int")
            entries = _stock_records(daily_bars(bars), info).select("symbol", shard.alias("document"), entry)
            dealt = entries.repartitionById(documents, "document").select("symbol", "entry")
        dealt = dealt.sortWithinPartitions("symbol")
        start = json.dumps({"metadata": {k: meta[k] for k in _META_KEYS if meta.get(k) is not None}})[:-1]
        dealt.mapInArrow(_document(f'{start},"stocks":{{'), "value string").write.text(f"{path}/documents")
        return
    raise ValueError(f"unknown layout {layout!r}")


def _document(start: str):
    """The text of a document, in lines, from the rows (symbol, entry) of a task, in order: no row holds more than one entry."""

    def work(batches):
        last = None
        for batch in batches:
            if not len(batch):
                continue
            symbols, entries = batch.column("symbol").to_pylist(), batch.column("entry").to_pylist()
            for before, symbol in zip([last, *symbols], symbols):
                if symbol is None or symbol == before:
                    raise ValueError(f"a document names each symbol once, not {symbol!r}")
            lines = [f"{start if last is None and not k else ','}{entry}" for k, entry in enumerate(entries)]
            last = symbols[-1]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["}}"])], ["value"])

    return work


#: Buckets of a snapshot that is renewed by symbol.
SNAPSHOT_BUCKETS = 64


def renew_snapshot(
    bars: DataFrame, info: DataFrame, meta: dict, path: str, buckets: int = SNAPSHOT_BUCKETS
) -> int:
    """Save a fetch into the ``keyed`` snapshot at ``path``, which it starts if there is none; the number of the new version.

    A fetched symbol's bars and info replace those it had, unless these are of a later fetch (``fetch_date_utc`` of
    ``meta``, text that sorts by time); other symbols stay. Bars hold one row a day and need no order. Only buckets of
    fetched symbols are rewritten. Bars and info change together, by one manifest: readers see the
    snapshot before or after, and a job that is stopped changes nothing.
    """
    spark = bars.sparkSession
    fetched = F.lit(meta.get("fetch_date_utc")).alias("fetched")
    details = F.col("details") if "details" in info.columns else F.lit(None)
    bar = F.struct("session_date", *K.OHLCV)
    known = F.struct("market_cap", "regular_market_price", details.cast("map<string,string>").alias("details"))
    held = info.select("symbol", fetched, F.lit(None).cast(_BAR).alias("bar"), known.alias("info"))
    rows = bars.select("symbol", fetched, bar.cast(_BAR).alias("bar"), F.lit(None).cast(held.schema["info"].dataType).alias("info"))

    def wins(old: DataFrame, new: DataFrame) -> DataFrame:
        """Symbols whose new rows count, from a row for each symbol and fetch."""
        day = F.coalesce("fetched", F.lit("")).alias("fetched")
        fetches = [rows.where("symbol is not null").select("symbol", day, F.lit(turn).alias("turn")).distinct() for rows, turn in ((old, 0), (new, 1))]
        newest = fetches[0].unionByName(fetches[1]).groupBy("symbol").agg(F.max(F.struct("fetched", "turn")).alias("newest"))
        return newest.where("newest.turn = 1").select("symbol")

    notes = {k: meta.get(k) for k in _META_KEYS}
    return KeyedTable(spark, path, "symbol", buckets).renew(rows.unionByName(held), wins, {"metadata": notes})


_BAR = "struct<session_date: date, open: double, high: double, low: double, close: double, volume: double>"


def _read_keyed(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """A version of a snapshot that is renewed by symbol; its metadata are the last fetch's, its stocks all symbols'."""
    table = KeyedTable.at(spark, path)
    said = table.manifest(version)[1]
    rows = table.read(said=said)
    if rows is None:
        rows = spark.createDataFrame([], f"symbol string, fetched string, bar {_BAR}, info struct<market_cap: double, regular_market_price: double, details: map<string,string>>")
    known = {k: said["notes"].get("metadata", {}).get(k) for k in _META_KEYS}
    return Snapshot(
        rows.where("bar is not null").select("symbol", "bar.*"),
        rows.where("info is not null").select("symbol", "info.*"),
        _metadata_row(rows.select("symbol").distinct(), known).select(
            *[F.col(c).cast(t) for c, t in (x.split() for x in METADATA_SCHEMA.split(", "))], "stock_count"),
        spark.createDataFrame([], "symbol string, message string"),
    )


_META_KEYS = ("fetch_date_utc", "source_ticker_file", "data_years_fetched")


def _metadata_row(symbols: DataFrame, meta: dict) -> DataFrame:
    return symbols.agg(F.count(F.lit(1)).alias("stock_count")).select(
        *[F.lit(meta.get(k)).alias(k) for k in _META_KEYS], "stock_count"
    )


def _open_info(info: DataFrame) -> Column:
    """The text of the company info as one JSON object: the two figures as numbers, and whatever else was known."""
    figures = F.to_json(F.struct(F.col("market_cap").alias(K.INFO_MARKET_CAP), F.col("regular_market_price").alias(K.INFO_MARKET_PRICE)))
    texts = [figures, F.to_json(F.coalesce("details", F.create_map().cast("map<string,string>")))] if "details" in info.columns else [figures]
    inside = F.filter(F.array(*[F.substr(t, F.lit(2), F.length(t) - 2) for t in texts]), lambda x: x != "")
    return F.concat(F.lit("{"), F.array_join(inside, ","), F.lit("}"))


def _stock_records(bars: DataFrame, info: DataFrame) -> DataFrame:
    histories = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(_bar())).alias("bars"))
    return histories.join(info.select("symbol", _open_info(info).alias("info")), "symbol", "left").select(*_record())


def _dealt_records(bars: DataFrame, info: DataFrame, documents: int) -> DataFrame:
    """Records as ``_stock_records`` gives them, from one shuffle of bars and info that deals symbols to documents, a partition each.

    Days are combined there, but trades (bars with a ``bar_order``) before it: a symbol may have any number of them.
    """
    order = F.col("session_date")
    if "bar_order" in bars.columns:
        bars, order = daily_bars(bars), F.lit(0)
    known = info.select("symbol", *[F.lit(None).cast(t).alias(c) for c, t in _BAR_KINDS.items()], _open_info(info).alias("info"))
    rows = bars.select("symbol", *[F.col(c).cast(t) for c, t in _BAR_KINDS.items()], F.lit(None).cast("string").alias("info"))
    rows = rows.withColumn("is_bar", F.lit(True)).unionByName(known.withColumn("is_bar", F.lit(False))).repartition(documents, "symbol")
    days = rows.groupBy("symbol", "session_date", "is_bar", "info").agg(*ohlcv(order), F.count_if(~F.col("is_bar")).alias("infos"))
    stocks = days.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_bar"), _bar()))).alias("bars"), F.max("info").alias("info"), F.sum("infos").alias("infos"))
    several = F.raise_error(F.concat(F.lit("info names each symbol once, not "), "symbol")).cast("string")
    one = F.when(F.col("infos") > 1, several).otherwise(F.col("info"))
    return stocks.where(F.size("bars") > 0).withColumn("info", one).select(*_record())


_BAR_KINDS = {"session_date": "date", **dict.fromkeys(K.OHLCV, "double")}


def _bar() -> Column:
    """A bar in few bytes: its text is made where the history is complete."""
    return F.struct("session_date", F.array(*[F.col(c) for c in K.OHLCV]).alias("cells"))


def _record() -> list[Column]:
    day = lambda b: F.concat(b["session_date"].cast("string"), F.lit("T00:00:00.000"))
    return [
        F.col("symbol"),
        F.parse_json(F.coalesce("info", F.lit("{}"))).alias("info"),
        F.struct(
            F.array(*[F.lit(f) for f in K.HISTORY_FIELDS]).alias("columns"),
            F.transform("bars", day).alias("index"),
            F.col("bars.cells").alias("data"),
        ).alias("history"),
    ]
