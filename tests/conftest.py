import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAR_SCHEMA = "symbol string, session_date date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bars_of(spark):
    """Bars from ``(symbol, date, close, volume)`` rows, other prices as the close."""

    def build(rows):
        from datetime import date

        full = [
            (s, date.fromisoformat(d), c, c, c, c, None if v is None else float(v)) for s, d, c, v in rows
        ]
        return spark.createDataFrame(full, BAR_SCHEMA)

    return build


@pytest.fixture
def weekly_of(spark):
    """Consecutive weeks that end on 2024-12-30, from lists of closes and volumes."""

    def build(series, last="2024-12-30"):
        from datetime import date, timedelta

        end = date.fromisoformat(last)
        rows = []
        for symbol, (closes, volumes) in series.items():
            n = len(closes)
            for i, (c, v) in enumerate(zip(closes, volumes)):
                rows.append((symbol, end - timedelta(weeks=n - 1 - i), c, c, c, c, float(v)))
        return spark.createDataFrame(rows, BAR_SCHEMA.replace("session_date", "week_end"))

    return build


@pytest.fixture
def info_of(spark):
    def build(caps):
        rows = [(s, None if c is None else float(c) * 1e6, 1.0) for s, c in caps.items()]
        return spark.createDataFrame(rows, "symbol string, market_cap double, regular_market_price double")

    return build
