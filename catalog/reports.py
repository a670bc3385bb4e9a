"""Result records, their display, and reasons for skipped symbols."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.functions import formatting as fmt
from barscreen.functions import predicates as P
from barscreen.session import scratch_path

from . import bindings as B
from . import sqltext as S
from .registry import query
from .screens import live, lookback, rounded, _LIVE

_MATCHES = S.with_(
    S.SUPPLIER_BARS, S.WEEKLY, S.finished(), S.features(B.SHORT), S.SUPPLIER_INFO, S.matches(B.SHORT, "lookback")
)


@query(f"{_MATCHES} SELECT {S.SLIM} FROM matches")
def slim_records(spark, sf_dir):
    weekly, info = B.supplier_weekly(spark, sf_dir), B.supplier_info(spark, sf_dir)
    return rounded(bs.to_slim(bs.screen_matches(weekly, info, B.SHORT, "lookback", B.AS_OF)))


@query(
    f"""{_MATCHES} SELECT {S.SLIM}, CAST(row_number() OVER (ORDER BY volume_ratio DESC, symbol) AS INTEGER) AS place
    FROM matches"""
)
def ranked_results(spark, sf_dir):
    """Ranks read off the order of the rows."""
    ranked = lookback(spark, sf_dir, B.SHORT)
    return rounded(_numbered(ranked))


@query(
    f"""{_MATCHES} SELECT {S.SLIM}, CAST(row_number() OVER (ORDER BY "close", symbol) AS INTEGER) AS place FROM matches"""
)
def sorted_results(spark, sf_dir):
    return rounded(_numbered(bs.sort_results(lookback(spark, sf_dir, B.SHORT), "close_price")))


def _numbered(ordered):
    """Place of each row in a sorted frame, from its partition and place in it.

    A global sort leaves partitions in order, so only one count per partition
    has to be shared. Matches go to a table first: rows must not move between
    the two passes.
    """
    spark = ordered.sparkSession
    path = scratch_path(spark, "ordered")
    placed = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    placed.write.parquet(path)
    rows = spark.read.parquet(path)
    first = F.shiftleft(F.col("part").cast("long"), 33)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = counts.select("part", before.alias("start"))
    place = (F.col("start") + F.col("id") - first + 1).cast("int")
    return rows.join(starts, "part").select(*ordered.columns, place.alias("place"))


def _cap_sql(value: str, dialect: str) -> str:
    small = (
        f"WHEN {value} >= 1e3 THEN printf('%.2f', {value} / 1e3) || 'K' ELSE printf('%.0f', {value})"
        if dialect == "live"
        else f"ELSE printf('%.0f', {value} / 1e3)"
    )
    return f"""CASE WHEN {value} IS NULL THEN 'N/A' WHEN {value} >= 1e9 THEN printf('%.2f', {value} / 1e9) || 'B'
      WHEN {value} >= 1e6 THEN printf('%.2f', {value} / 1e6) || 'M' {small} END"""


_CAPS = {"tiny": 0.001, "small": 1.0, "mid": 1000.0, "large": 100000.0}


@query(
    f"""SELECT o_orderkey, {", ".join(
        f"{_cap_sql(f'(v * {m})', d)} AS {k}_{d}" for k, m in _CAPS.items() for d in ("live", "snapshot"))}
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)"""
)
def format_cap(spark, sf_dir):
    cap = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[
            fmt.format_market_cap(cap * m, dialect).alias(f"{k}_{dialect}")
            for k, m in _CAPS.items()
            for dialect in ("live", "snapshot")
        ],
    )


_LINKS = """'https://finance.yahoo.com/quote/' || ticker AS quote_url,
  'https://www.tradingview.com/chart/?symbol=' ||
    CASE WHEN ends_with(ticker, '.AX') THEN 'ASX:' || left(ticker, length(ticker) - 3) ELSE ticker END AS chart_url"""


def _display_sql(dialect: str, extra: str = "") -> str:
    return f"""SELECT ticker, date, printf('%.2f', close_price) AS close_price, {_cap_sql('market_cap', dialect)} AS market_cap,
      format('{{:,.0f}}', avg_volume) AS avg_volume, printf('%.2f', volume_ratio) || 'x' AS volume_ratio {extra}, {_LINKS}
    FROM (SELECT symbol AS ticker, strftime(week_end, '%Y-%m-%d') AS date, "close" AS close_price, * FROM matches)"""


@query(f"{_MATCHES} {_display_sql('lookback')}")
def display_rows(spark, sf_dir):
    return bs.to_display(lookback(spark, sf_dir, B.SHORT), "lookback")


_LABEL = "CASE {s} WHEN 'pass' THEN 'Yes' WHEN 'fail' THEN 'No' WHEN 'omitted' THEN 'Omit' ELSE 'N/A' END"


@query(
    f"""{_LIVE} {_display_sql("live", "".join(
        ", " + _LABEL.format(s=S.state(k, n)) + f" AS ma_{k}_pass" for k, n in B.NEWEST.ma_periods.items()))}"""
)
def display_rows_live(spark, sf_dir):
    return bs.to_display(live(spark, sf_dir), "live")


@query(
    f"""{S.with_(S.SUPPLIER_BARS, S.WEEKLY, f"weeks AS (SELECT * FROM weekly WHERE {S.USABLE})", S.features(B.DEFAULT))}
    SELECT symbol, week_end, {", ".join(
        _LABEL.format(s=S.state(k, n)) + f" AS label_{k}" for k, n in B.DEFAULT.ma_periods.items())} FROM features"""
)
def ma_labels(spark, sf_dir):
    states = bs.usable_weeks(B.supplier_weekly(spark, sf_dir)).select(
        "symbol", "week_end", *P.ma_states(B.DEFAULT.ma_periods)
    )
    return states.select(
        "symbol", "week_end", *[fmt.ma_label(f"state_{k}").alias(f"label_{k}") for k in B.DEFAULT.ma_periods]
    )


@query(
    f"""SELECT ticker, {_LINKS} FROM
    (SELECT CASE WHEN c_acctbal < 0 THEN c_name || '.AX' ELSE c_name END AS ticker FROM customer)"""
)
def chart_url(spark, sf_dir):
    name = F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit(".AX"))).otherwise(F.col("c_name"))
    named = B.table(spark, sf_dir, "customer").select(name.alias("ticker"))
    return named.select("ticker", fmt.quote_url("ticker").alias("quote_url"), fmt.chart_url("ticker").alias("chart_url"))


_UNIVERSE = "universe AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol FROM customer)"


def _reasons_sql(c, dialect: str) -> str:
    """Steps in the order in which each dialect gives up on a symbol."""
    extra = 1 if dialect == "lookback" else 0
    weeks = c.lookback_weeks if dialect == "lookback" else 1
    steps = {
        "missing_info": "i.symbol IS NULL",
        "missing_history": "w.symbol IS NULL",
        "no_valid_weeks": "n_usable = 0",
        "no_finished_weeks": "n_finished = 0",
        "no_recent_data": f"date_diff('day', last_week, DATE '{B.AS_OF}') > 7",
        "too_young_short": f"b < {c.ma_short + extra}",
        "too_young_intermediate": f"b < {c.ma_intermediate}",
        "too_young_volume": f"b < {c.avg_volume_weeks + extra}",
        "cap_missing": f"market_cap IS NULL AND {c.min_market_cap} > 0",
        "cap_below_min": f"{c.min_market_cap} > 0 AND market_cap / 1000000 < {c.min_market_cap}",
        "cap_above_max": f"{c.max_market_cap} > 0 AND market_cap / 1000000 > {c.max_market_cap}",
        "matched": "hit",
        "no_week_matched": "TRUE",
    }
    caps = ["cap_missing", "cap_below_min", "cap_above_max"]
    order = {
        "live": [*caps, "missing_history", "no_valid_weeks", "no_finished_weeks", "no_recent_data", "too_young_short",
                 "too_young_intermediate", "too_young_volume", "matched", "no_week_matched"],
        "snapshot": ["missing_info", "missing_history", *caps, "no_valid_weeks", "no_finished_weeks",
                     "too_young_short", "too_young_volume", "matched", "no_week_matched"],
        "lookback": ["missing_history", "no_valid_weeks", "no_finished_weeks", "too_young_short", "too_young_volume",
                     *caps, "matched", "no_week_matched"],
    }[dialect]
    if dialect == "lookback":
        steps |= {k: f"hit AND ({steps[k]})" for k in caps}
    cap_text = "printf('%.2f', market_cap / 1000000) || 'M'"
    details = {
        "cap_below_min": cap_text,
        "cap_above_max": cap_text,
        "no_recent_data": "strftime(last_week, '%Y-%m-%d')",
        "too_young_short": f"'{c.ma_short} weeks'",
        "too_young_intermediate": f"'{c.ma_intermediate} weeks'",
        "too_young_volume": f"'{c.avg_volume_weeks} weeks'",
        "no_week_matched": "'of ' || n_judged || ' weeks judged, ' || n_spikes || ' spiked, ' || n_rising || ' rose, ' || n_above"
                           " || ' held their averages'",
    }
    chain = " ".join(f"WHEN {steps[k]} THEN '{k}'" for k in order)
    texts = " ".join(f"WHEN '{k}' THEN {text}" for k, text in details.items())
    met = " AND ".join(
        f"({x})" for x in (S.gate(c, dialect), S.recent(dialect, B.AS_OF), S.spike(c), S.rising(c), S.above(c))
    )
    return f"""{S.with_(S.GAPPY_BARS, S.WEEKLY, S.finished(), S.features(c), S.LISTED_INFO, _UNIVERSE)},
    counted AS (SELECT symbol, count(*) FILTER (WHERE {S.USABLE}) AS n_usable,
                       count(*) FILTER (WHERE {S.USABLE} AND week_end <= DATE '{B.AS_OF}') AS n_finished
                FROM weekly GROUP BY symbol),
    seen AS (SELECT symbol, max(b) AS b, max(week_end) AS last_week, bool_or({met}) AS hit, count(*) AS n_judged,
                    count(*) FILTER (WHERE {S.spike(c)}) AS n_spikes, count(*) FILTER (WHERE {S.rising(c)}) AS n_rising,
                    count(*) FILTER (WHERE {S.above(c)}) AS n_above
             FROM features WHERE age <= {weeks} GROUP BY symbol),
    explained AS (SELECT u.symbol, CASE {chain} END AS reason, CASE reason {texts} END AS detail
      FROM universe u LEFT JOIN counted w USING (symbol) LEFT JOIN seen s USING (symbol) LEFT JOIN info i USING (symbol))"""


def _explained(spark, sf_dir, config, dialect):
    universe = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
    weekly, info = B.gappy_weekly(spark, sf_dir), B.listed_info(spark, sf_dir)
    return bs.explain_screen(weekly, info, config, dialect, B.AS_OF, universe)


@query(f"{_reasons_sql(B.NEWEST, 'live')} SELECT symbol, reason, detail FROM explained")
def skip_reasons_live(spark, sf_dir):
    return _explained(spark, sf_dir, B.NEWEST, "live").select("symbol", "reason", "detail")


@query(f"{_reasons_sql(B.CAPPED, 'snapshot')} SELECT symbol, reason, detail FROM explained")
def skip_reasons_snapshot(spark, sf_dir):
    return _explained(spark, sf_dir, B.CAPPED, "snapshot").select("symbol", "reason", "detail")


@query(f"{_reasons_sql(B.CAPPED, 'lookback')} SELECT symbol, reason, detail FROM explained")
def skip_reasons(spark, sf_dir):
    return _explained(spark, sf_dir, B.CAPPED, "lookback").select("symbol", "reason", "detail")


@query(
    f"{_reasons_sql(B.CAPPED, 'lookback')} "
    "SELECT count(*) FILTER (WHERE reason = 'matched') AS matched, count(*) AS total FROM explained"
)
def screen_summary(spark, sf_dir):
    return bs.screen_summary(_explained(spark, sf_dir, B.CAPPED, "lookback"))
