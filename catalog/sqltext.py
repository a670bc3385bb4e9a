"""Building blocks of the checking SQL, written against the given tables."""

from __future__ import annotations

from barscreen import ScreenConfig

from .bindings import AS_OF

SUPPLIER_BARS = """
bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session_date,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS ord,
         l_extendedprice AS "open", l_extendedprice AS high, l_extendedprice AS low,
         l_extendedprice AS "close", l_quantity AS volume
  FROM lineitem)"""

GAPPY_BARS = """
bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session_date,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS ord,
         price AS "open", price AS high, price AS low, price AS "close",
         CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END AS volume
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price FROM lineitem))"""

BRAND_BARS = """
bars AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS session_date,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord,
         l_extendedprice - l_discount AS "open", l_extendedprice * 1.5 AS high, l_extendedprice * 0.5 AS low,
         l_extendedprice AS "close", l_quantity AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CUSTOMER_BARS = """
bars AS (
  SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS session_date,
         row(o_orderdate, o_orderkey) AS ord,
         o_totalprice AS "open", o_totalprice AS high, o_totalprice AS low, o_totalprice AS "close", CAST(1 AS DOUBLE) AS volume
  FROM orders)"""

WEEK_END = "CAST(date_trunc('week', session_date - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)"

_OHLCV = """
         min_by("open", ord) FILTER (WHERE "open" IS NOT NULL) AS "open", max(high) AS high, min(low) AS low,
         max_by("close", ord) FILTER (WHERE "close" IS NOT NULL) AS "close", coalesce(sum(volume), 0.0) AS volume"""

WEEKLY = f"""
weekly AS (
  SELECT symbol, {WEEK_END} AS week_end, {_OHLCV}
  FROM bars GROUP BY ALL)"""

DAILY = f"""
daily AS (
  SELECT symbol, session_date, {_OHLCV}
  FROM bars GROUP BY ALL)"""

USABLE = '"close" IS NOT NULL AND volume > 0'

SUPPLIER_INFO = """
info AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol,
         CASE WHEN s_acctbal >= 0 THEN s_acctbal * 1000000 END AS market_cap,
         CASE WHEN s_nationkey <> 0 THEN abs(s_acctbal) END AS regular_market_price
  FROM supplier)"""

LISTED_INFO = SUPPLIER_INFO.replace("FROM supplier)", "FROM supplier WHERE s_nationkey <> 0)")

CUSTOMER_INFO = """
info AS (
  SELECT CAST(c_custkey AS VARCHAR) AS symbol,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal * 1000000 END AS market_cap,
         CASE WHEN c_nationkey <> 0 THEN abs(c_acctbal) END AS regular_market_price
  FROM customer)"""


def finished(as_of: str | None = AS_OF) -> str:
    over = f" AND week_end <= DATE '{as_of}'" if as_of else ""
    return f"weeks AS (SELECT * FROM weekly WHERE {USABLE}{over})"


def mean(column: str, n: int, fraction: float = 0.8) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY week_end ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    needed = max(int(n * fraction), 1)
    # Decimal sums are exact, so a mean does not depend on the order of its addends.
    exact = f'CAST("{column}" AS DECIMAL(18, 6))'
    return f'CASE WHEN count("{column}") {frame} >= {needed} THEN avg({exact}) {frame} END'


def double_mean(value: str, n: int, fraction: float = 0.8) -> str:
    """The mean of doubles, which knows nothing of decimals."""
    frame = f"OVER (PARTITION BY symbol ORDER BY week_end ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({value}) {frame} >= {max(int(n * fraction), 1)} THEN avg({value}) {frame} END"


POSITION = "CAST(row_number() OVER (PARTITION BY symbol ORDER BY week_end) - 1 AS INTEGER)"
AGE = "CAST(row_number() OVER (PARTITION BY symbol ORDER BY week_end DESC) AS INTEGER)"


def features(c: ScreenConfig) -> str:
    averages = ", ".join(f"{mean('close', n)} AS ma_{name}" for name, n in c.ma_periods.items())
    return f"""
features AS (
  SELECT symbol, week_end, "close", volume, {POSITION} AS b, {AGE} AS age,
         {mean('volume', c.avg_volume_weeks)} AS avg_volume,
         {mean('close', c.price_avg_weeks, 1.0)} AS recent_mean, {averages}
  FROM weeks)"""


def state(name: str, n: int) -> str:
    return f"""CASE WHEN b < {n} THEN 'omitted' WHEN "close" > ma_{name} THEN 'pass' ELSE 'fail' END"""


GATES = {
    "live": "b >= {s} AND b >= {i} AND b >= {v}",
    "snapshot": "b >= {s} AND b >= {v}",
    "lookback": "b >= {s} + 1 AND b >= {v} + 1",
}


def gate(c: ScreenConfig, dialect: str) -> str:
    return GATES[dialect].format(s=c.ma_short, i=c.ma_intermediate, v=c.avg_volume_weeks)


def cap(c: ScreenConfig) -> str:
    low = f"market_cap / 1000000 >= {c.min_market_cap}" if c.min_market_cap > 0 else "TRUE"
    high = f"market_cap / 1000000 <= {c.max_market_cap}" if c.max_market_cap > 0 else "TRUE"
    missing = "FALSE" if c.min_market_cap > 0 else "TRUE"
    return f"CASE WHEN market_cap IS NULL THEN {missing} ELSE {low} AND {high} END"


def spike(c: ScreenConfig) -> str:
    return f"coalesce(avg_volume <> 0 AND volume >= {c.volume_multiplier} * avg_volume, FALSE)"


def rising(c: ScreenConfig) -> str:
    return f'coalesce(b >= {c.price_avg_weeks} AND "close" > recent_mean, FALSE)'


def above(c: ScreenConfig) -> str:
    return " AND ".join(f"({state(name, n)}) <> 'fail'" for name, n in c.ma_periods.items())


def recent(dialect: str, as_of: str | None) -> str:
    return f"date_diff('day', week_end, DATE '{as_of}') <= 7" if dialect == "live" else "TRUE"


def matches(c: ScreenConfig, dialect: str, as_of: str | None = AS_OF, newest: bool = True) -> str:
    """CTE ``matches`` over ``features`` and ``info``."""
    weeks = c.lookback_weeks if dialect == "lookback" else 1
    join = "JOIN" if dialect == "snapshot" else "LEFT JOIN"
    pick = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY age) = 1" if newest else ""
    return f"""
matches AS (
  SELECT f.*, market_cap, volume / avg_volume AS volume_ratio
  FROM features f {join} info USING (symbol)
  WHERE age <= {weeks} AND {gate(c, dialect)} AND {recent(dialect, as_of)}
    AND {spike(c)} AND {rising(c)} AND {above(c)} AND {cap(c)}
  {pick})"""


SLIM = """symbol AS ticker, strftime(week_end, '%Y-%m-%d') AS date, "close" AS close_price, market_cap,
       round(avg_volume, 6) AS avg_volume, round(volume_ratio, 6) AS volume_ratio"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


def screen_sql(c: ScreenConfig, dialect: str, info: str = SUPPLIER_INFO, select: str = SLIM) -> str:
    ctes = with_(SUPPLIER_BARS, WEEKLY, finished(), features(c), info, matches(c, dialect))
    return f"{ctes} SELECT {select} FROM matches"
