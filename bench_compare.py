"""

    python bench_compare.py [sf_dir]
"""

from __future__ import annotations

import statistics
import sys
import time
from dataclasses import replace

import pandas as pd

import barscreen as bs
import check
from barscreen.session import scratch_path
from catalog import REGISTRY
from catalog import bindings as B
from tests import pandas_screen

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"


def seconds(action, runs: int = 5) -> float:
    taken = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        action()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken[1:])


def spark_run(make):
    return lambda: make().write.format("noop").mode("overwrite").save()


def main() -> None:
    spark, con = check.session(), check.connect(SF)
    for name in ("weekly_bars", "trailing_means", "screen_lookback", "screen_lookback_default", "screen_many"):
        fn, sql = REGISTRY[name]
        print(f"{name}: Spark {seconds(spark_run(lambda: fn(spark, SF))):.2f}s", end=", ", flush=True)
        print(f"DuckDB {seconds(lambda: con.sql(sql).to_arrow_table()):.2f}s", flush=True)

    stored = scratch_path(spark, "weekly")
    B.supplier_weekly(spark, SF).write.parquet(stored)
    weekly, info = spark.read.parquet(stored), B.supplier_info(spark, SF)
    print(f"screen_lookback on stored weeks: {seconds(spark_run(lambda: bs.screen(weekly, info, B.SHORT, 'lookback', B.AS_OF))):.2f}s")
    for n in (1, 20):
        many = {str(i): replace(B.SHORT, volume_multiplier=1 + i / 20) for i in range(n)}
        print(f"screen_many on stored weeks, {n} screens: {seconds(spark_run(lambda: bs.screen_many(weekly, info, many, 'lookback', B.AS_OF))):.2f}s")

    whole = B.supplier_bars(spark, SF)
    print(f"two exchanges: {seconds(spark_run(lambda: bs.screen(bs.weekly_bars(whole), info, B.SHORT, 'lookback', B.AS_OF))):.2f}s")
    moved = whole.repartition("symbol")
    print(f"one exchange of raw rows: {seconds(spark_run(lambda: bs.screen(bs.weekly_bars(moved), info, B.SHORT, 'lookback', B.AS_OF))):.2f}s")

    rows = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])
    rows = rows.sort_values(["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], kind="stable")
    bars = pd.DataFrame({"symbol": rows.l_suppkey.astype(str), "session_date": rows.l_shipdate, "close": rows.l_extendedprice, "volume": rows.l_quantity})
    caps = {r.symbol: r.market_cap for r in info.select("symbol", "market_cap").collect()}
    for label, cfg in (("screen_lookback", B.SHORT), ("screen_lookback_default", B.DEFAULT)):
        start = time.perf_counter()
        found = pandas_screen.run(bars, caps, cfg, "lookback", B.AS_OF)
        print(f"{label}: one symbol at a time in pandas {time.perf_counter() - start:.1f}s, {len(found)} matches", flush=True)


if __name__ == "__main__":
    main()
