"""Symbol lists, snapshots, wide frames and settings, written and read back."""

from pyspark.sql import functions as F

import barscreen as bs
from barscreen.config import settings_frame
from barscreen.functions.formatting import with_suffix
from barscreen.plans.diagnostics import explain_screen
from barscreen.session import scratch_path
from barscreen.sources.snapshot import read_snapshot, write_snapshot

from . import bindings as B
from . import sqltext as S
from .registry import query
from .screens import SWEEP, rounded, sweep_sql

# Lines in every form that a list may hold, one per part.
_LINE = {
    "scan": """CASE p_type WHEN 'ECONOMY' THEN '# ' || p_name WHEN 'SMALL' THEN '  ' || lower(p_brand) || ' '
               WHEN 'PROMO' THEN p_brand || ' | ' || p_name WHEN 'LARGE' THEN ' ' ELSE p_brand || '.AX' END""",
}
_ENTRY = f"SELECT trim({_LINE['scan']}) AS line FROM part"


def _list_sql(suffix_delimited: bool) -> str:
    bare = "upper(trim(split_part(line, '|', 1)))"
    keep = "FALSE" if suffix_delimited else "contains(line, '|')"
    return f"""WITH lines AS ({_ENTRY}), entries AS (
      SELECT {bare} AS s, {keep} AS as_is FROM lines WHERE line <> '' AND NOT starts_with(line, '#'))
    SELECT CASE WHEN as_is OR ends_with(s, '.AX') THEN s ELSE s || '.AX' END AS symbol FROM entries WHERE s <> ''"""


def _written_list(spark, sf_dir):
    path = scratch_path(spark, "asx_list")
    lines = B.table(spark, sf_dir, "part").select(F.expr(_LINE["scan"]).alias("value"))
    header = lines.sparkSession.createDataFrame([("Symbol|Security Name",)], "value string")
    lines.unionByName(header).write.text(path)
    return path


@query(_list_sql(suffix_delimited=True))
def symbol_list_fetch(spark, sf_dir):
    return bs.read_symbols(spark, _written_list(spark, sf_dir), "fetch", ".AX")


@query(_list_sql(suffix_delimited=False))
def symbol_list_scan(spark, sf_dir):
    return bs.read_symbols(spark, _written_list(spark, sf_dir), "scan", ".AX")


@query("SELECT DISTINCT upper(p_brand) AS symbol FROM part")
def symbol_list_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "symbols")
    table = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("Brand code"), "p_name")
    bs.write_symbols(bs.distinct_symbols(bs.symbols_from_table(table)), path)
    return bs.read_symbols(spark, path)


@query("SELECT c_custkey, CASE WHEN ends_with(s, '.AX') THEN s ELSE s || '.AX' END AS symbol FROM "
       "(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name || '.AX' ELSE c_name END AS s FROM customer)")
def symbol_suffix(spark, sf_dir):
    name = F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit(".AX"))).otherwise(F.col("c_name"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", with_suffix(name).alias("symbol"))


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem")
def distinct_symbols(spark, sf_dir):
    return bs.distinct_symbols(B.supplier_bars(spark, sf_dir).select("symbol"))


@query("SELECT upper(trim(c_mktsegment)) AS symbol FROM customer")
def symbols_from_table(spark, sf_dir):
    renamed = B.table(spark, sf_dir, "customer").withColumnsRenamed({"c_mktsegment": "Sector Code", "c_name": "Name"})
    return bs.symbols_from_table(renamed.select("Name", "Sector Code"))


@query(f"{S.with_(S.SUPPLIER_INFO)} SELECT * FROM info WHERE regular_market_price IS NOT NULL")
def valid_info(spark, sf_dir):
    return bs.valid_info(B.supplier_info(spark, sf_dir))


# Requested: every order's customer, as often as they order, and every supplier.
_REQUESTED = """requested AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol FROM orders
  UNION ALL SELECT 'S' || s_suppkey FROM supplier)"""


def _requested(spark, sf_dir):
    customers = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"))
    suppliers = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    return customers.unionByName(suppliers)


@query(
    f"""{S.with_(S.CUSTOMER_BARS, S.CUSTOMER_INFO, _REQUESTED)}, flags AS (
      SELECT r.symbol, r.symbol IN (SELECT symbol FROM bars) AS hist, i.symbol IS NOT NULL AS known, i.market_cap
      FROM requested r LEFT JOIN (SELECT * FROM info WHERE regular_market_price IS NOT NULL) i USING (symbol))
    SELECT count(*) AS symbols_requested, count(DISTINCT symbol) FILTER (WHERE hist) AS symbols_saved,
           count(*) FILTER (WHERE NOT hist) AS no_history, count(*) FILTER (WHERE hist AND NOT known) AS no_info,
           count(*) FILTER (WHERE hist AND known AND market_cap IS NULL) AS no_market_cap FROM flags"""
)
def coverage_report(spark, sf_dir):
    return bs.coverage_report(_requested(spark, sf_dir), B.customer_bars(spark, sf_dir), B.customer_info(spark, sf_dir))


@query(f"{S.with_(S.CUSTOMER_BARS, _REQUESTED)} SELECT symbol FROM requested WHERE symbol NOT IN (SELECT symbol FROM bars)")
def missing_symbols(spark, sf_dir):
    return bs.missing_symbols(_requested(spark, sf_dir), B.customer_bars(spark, sf_dir))


@query(f"""{S.with_(S.BRAND_BARS, S.DAILY)} SELECT symbol, session_date, "open", high, low, "close", volume FROM daily""")
def wide_to_long(spark, sf_dir):
    """Daily bars spread to one column per brand and field, and gathered again."""
    daily = bs.daily_bars(B.brand_bars(spark, sf_dir))
    wide = daily.groupBy("session_date").pivot("symbol").agg(
        F.max("open").alias("Open"),
        F.max("high").alias("High"),
        F.max("low").alias("Low"),
        F.max("close").alias("Close"),
        F.max("volume").alias("Volume"),
    )
    return bs.drop_empty_bars(bs.bars_from_wide(wide, sep="_"))


_META = {
    "fetch_date_utc": "2001-11-05T03:04:05.678901+00:00",
    "source_ticker_file": "suppliers",
    "data_years_fetched": 15,
}


def _daily_table(spark, sf_dir):
    """Daily bars of the suppliers, worked out once for queries that save them several times."""
    path = scratch_path(spark, "daily")
    bs.daily_bars(B.supplier_bars(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def _saved(spark, sf_dir, layout):
    path = scratch_path(spark, f"snapshot_{layout}")
    bars = bs.daily_bars(B.supplier_bars(spark, sf_dir))
    write_snapshot(bars, B.listed_info(spark, sf_dir), _META, path, layout, symbols_per_document=40)
    return read_snapshot(spark, path, layout)


_SNAPSHOT = f"""{S.with_(S.SUPPLIER_BARS, S.DAILY, S.LISTED_INFO)}
SELECT symbol, session_date, "open", high, low, "close", volume, market_cap, regular_market_price
FROM daily LEFT JOIN info USING (symbol)"""


def _with_info(snapshot):
    return snapshot.bars.drop("bar_year").join(snapshot.info.drop("details"), "symbol", "left")


_ODD_CELLS = """CASE WHEN l_linenumber = 7 THEN 'close is no number' WHEN l_linenumber = 6 THEN 'no date'
      WHEN l_suppkey % 50 = 3 THEN 'no symbol' WHEN l_linenumber = 5 AND l_quantity > 25 THEN 'no figures' END"""


@query(
    f"""SELECT CASE WHEN l_suppkey % 50 <> 3 THEN CAST(l_suppkey AS VARCHAR) END AS symbol, outcome, count(*) AS n,
      sum(CASE WHEN outcome = 'bar' THEN l_quantity END) AS volume
    FROM (SELECT *, coalesce(CASE WHEN l_suppkey % 50 = 3 THEN 'no symbol' WHEN l_linenumber = 6 THEN 'no date' END, {_ODD_CELLS}, 'bar') AS outcome
          FROM lineitem) GROUP BY ALL"""
)
def rejected_rows(spark, sf_dir):
    """A table of text with odd cells: rows that are no bars are stored beside the bars, with a reason, in the same pass."""
    path = scratch_path(spark, "rejected_rows")
    number, many = F.col("l_linenumber"), (F.col("l_linenumber") == 5) & (F.col("l_quantity") > 25)
    cell = lambda c: F.when(~many, F.col(c).cast("string"))
    table = B.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 50 != 3, F.col("l_suppkey").cast("string")).otherwise(" ").alias("code"),
        F.when(number == 6, "soon").otherwise(F.col("l_shipdate").cast("string")).alias("day"),
        F.when(number == 7, "n/a").otherwise(cell("l_extendedprice")).alias("price"), cell("l_quantity").alias("volume"))
    bars = bs.checked_bars(table, "code", "day", "price", "volume")
    write_snapshot(bars, B.listed_info(spark, sf_dir), _META, path, "parquet")
    snapshot = read_snapshot(spark, path, "parquet")
    reason = F.substring_index("message", ":", 1)
    rows = snapshot.bars.select("symbol", F.lit("bar").alias("outcome"), "volume").unionByName(
        snapshot.errors.select("symbol", reason.alias("outcome"), F.lit(None).cast("double").alias("volume")))
    return rows.groupBy("symbol", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query(_SNAPSHOT)
def snapshot_parquet(spark, sf_dir):
    return _with_info(_saved(spark, sf_dir, "parquet"))


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.DAILY)} SELECT symbol, session_date, "close", volume FROM daily
    WHERE session_date >= DATE '1998-11-04' AND session_date < DATE '{B.AS_OF}'"""
)
def snapshot_recent_years(spark, sf_dir):
    """Bars of the last three years, read from the folders of those years."""
    bars = bs.history_range(_saved(spark, sf_dir, "parquet").bars, B.AS_OF, 3, "calendar")
    return bars.select("symbol", "session_date", "close", "volume")


@query(_SNAPSHOT)
def snapshot_jsonl(spark, sf_dir):
    return _with_info(_saved(spark, sf_dir, "jsonl"))


@query(_SNAPSHOT)
def snapshot_bundle(spark, sf_dir):
    return _with_info(_saved(spark, sf_dir, "bundle"))


@query(_SNAPSHOT)
def snapshot_document(spark, sf_dir):
    """One document with all symbols, read in byte ranges."""
    path = scratch_path(spark, "snapshot_document")
    bars = bs.daily_bars(B.supplier_bars(spark, sf_dir))
    write_snapshot(bars, B.listed_info(spark, sf_dir), _META, path, "bundle", symbols_per_document=1 << 40)
    return _with_info(read_snapshot(spark, path, "document"))


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.DAILY, S.LISTED_INFO)}
    SELECT symbol, session_date, "close" + CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS "close",
      CASE WHEN CAST(symbol AS BIGINT) % 6 <> 3 THEN market_cap END AS market_cap
    FROM daily LEFT JOIN info USING (symbol) WHERE CAST(symbol AS BIGINT) % 3 <> 0 OR session_date >= DATE '1997-01-01'"""
)
def snapshot_renewed(spark, sf_dir):
    """Of three fetches into one snapshot the newest of each symbol counts: the second has every third symbol, the last is old."""
    path = scratch_path(spark, "snapshot_renewed")
    bars, info = _daily_table(spark, sf_dir), B.listed_info(spark, sf_dir)
    third, even = F.col("symbol").cast("long") % 3 == 0, F.col("symbol").cast("long") % 2 == 0
    newer = bars.where(third & (F.col("session_date") >= "1997-01-01")).withColumn("close", F.col("close") + 1)
    held = bars.select("symbol").distinct()
    for rows, known, day in ((bars, info, "2001-11-05"), (newer, info.where(third & even), "2001-11-07"), (bars.withColumn("close", -F.col("close")), info, "2001-11-04")):
        known = known.join(held, "symbol", "left_semi")
        bs.renew_snapshot(rows, known, {**_META, "fetch_date_utc": f"{day}T03:04:05+00:00"}, path, buckets=8)
    return _with_info(read_snapshot(spark, path, "keyed")).select("symbol", "session_date", "close", "market_cap")


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.DAILY)} SELECT symbol, session_date, "close", volume FROM daily"""
)
def snapshot_overlap(spark, sf_dir):
    """Two snapshots that hold the same symbols: the newer one counts, and no bar is there twice."""
    path = scratch_path(spark, "snapshot_overlap")
    bars = _daily_table(spark, sf_dir)
    old = bars.withColumn("volume", F.col("volume") * 3)
    for name, held, day in (("a", bars, "2001-11-05"), ("b", old, "2001-11-04")):
        write_snapshot(held, B.listed_info(spark, sf_dir), {**_META, "fetch_date_utc": f"{day}T03:04:05+00:00"}, f"{path}/{name}", "bundle")
    return read_snapshot(spark, path, "bundle").bars.select("symbol", "session_date", "close", "volume")


@query(
    f"""{S.with_(S.LISTED_INFO)} SELECT layout, symbol, s_name AS "name", market_cap FROM info
    JOIN supplier ON symbol = CAST(s_suppkey AS VARCHAR) JOIN (VALUES ('parquet'), ('jsonl'), ('bundle')) AS l(layout) ON TRUE
    WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)"""
)
def snapshot_open_info(spark, sf_dir):
    """What else is known of a company is kept by all layouts."""
    names = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.create_map(F.lit("name"), "s_name").alias("details"))
    bars, info = bs.daily_bars(B.supplier_bars(spark, sf_dir)), B.listed_info(spark, sf_dir).join(names, "symbol")
    found = []
    for layout in ("parquet", "jsonl", "bundle"):
        path = scratch_path(spark, f"open_{layout}")
        write_snapshot(bars, info.join(bars.select("symbol").distinct(), "symbol", "left_semi"), _META, path, layout)
        read = read_snapshot(spark, path, layout).info
        found.append(read.select(F.lit(layout).alias("layout"), "symbol", F.col("details")["name"].alias("name"), "market_cap"))
    return found[0].union(found[1]).union(found[2])


@query(
    """SELECT '2001-11-05 03:04 UTC' AS fetched_text, 'suppliers' AS source_ticker_file,
    CAST(15 AS INTEGER) AS data_years_fetched, count(DISTINCT l_suppkey) AS stock_count FROM lineitem"""
)
def snapshot_metadata(spark, sf_dir):
    return bs.snapshot_metadata(_saved(spark, sf_dir, "bundle")).drop("fetched_at")


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.DAILY)}
    SELECT s.symbol, CASE WHEN damaged THEN 'error' ELSE 'readable' END AS outcome,
           CASE WHEN damaged THEN 0 ELSE n END AS n_bars
    FROM (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_nationkey = 0 AS damaged FROM supplier) s
    JOIN (SELECT symbol, count(*) AS n FROM daily GROUP BY symbol) USING (symbol)"""
)
def record_errors(spark, sf_dir):
    """A damaged record costs one symbol, is reported, and leaves the rest readable."""
    clean = scratch_path(spark, "clean")
    write_snapshot(B.supplier_bars(spark, sf_dir), B.supplier_info(spark, sf_dir), _META, clean, "jsonl")
    damaged = B.table(spark, sf_dir, "supplier").filter("s_nationkey = 0")
    damaged = damaged.select(F.col("s_suppkey").cast("string").alias("symbol"), F.lit(True).alias("is_damaged"))
    records = spark.read.text(f"{clean}/stocks").withColumn("symbol", F.get_json_object("value", "$.symbol"))
    value = F.when(F.col("is_damaged"), F.regexp_replace("value", r"\}$", "")).otherwise(F.col("value"))
    path = scratch_path(spark, "damaged")
    records.join(damaged, "symbol", "left").select(value.alias("value")).write.text(f"{path}/stocks")
    spark.read.text(f"{clean}/metadata").write.text(f"{path}/metadata")
    snapshot = read_snapshot(spark, path, "jsonl")
    symbols = B.supplier_info(spark, sf_dir).select("symbol")
    explained = explain_screen(
        bs.weekly_bars(snapshot.bars), snapshot.info, B.SHORT, "lookback", B.AS_OF, symbols, snapshot.errors
    )
    outcome = F.when(F.col("reason") == "error", F.lit("error")).otherwise(F.lit("readable"))
    bars = snapshot.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return explained.join(bars, "symbol", "left").select(
        "symbol", outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n_bars")
    )


@query(sweep_sql(SWEEP))
def settings_lines(spark, sf_dir):
    """All screens in one file, one a line."""
    path = scratch_path(spark, "settings")
    settings_frame(spark, SWEEP).coalesce(1).write.json(path)
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return rounded(bs.screen_many(weekly, info, bs.read_settings(spark, path), "lookback", B.AS_OF))


@query(sweep_sql(SWEEP))
def settings_sweep(spark, sf_dir):
    """Saved settings files, read back and run in one pass."""
    path = scratch_path(spark, "settings")
    bs.write_settings(spark, SWEEP, path)
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return rounded(bs.screen_many(weekly, info, bs.read_settings(spark, path), "lookback", B.AS_OF))
