import pytest
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.functions import formatting as fmt


def text(spark, column_of, value, kind="double"):
    return spark.range(1).select(column_of(F.lit(value).cast(kind))).first()[0]


@pytest.mark.parametrize(
    "value, live, other",
    [
        (None, "N/A", "N/A"), (999, "999", "1"), (1500, "1.50K", "2"), (2.5e6, "2.50M", "2.50M"), (3e9, "3.00B", "3.00B"),
        (0.4, "0", "0"), (1e12, "1000.00B", "1000.00B"), (999_999, "1000.00K", "1000"),
    ],
)
def test_market_cap_text(spark, value, live, other):
    assert text(spark, lambda c: fmt.format_market_cap(c, "live"), value) == live
    assert text(spark, lambda c: fmt.format_market_cap(c, "lookback"), value) == other


@pytest.mark.parametrize("value", [2.675, 0.125, 1234567.5, 0.005, 1e-9, 99.995, 12345.678])
def test_fixed_rounds_like_print(spark, value):
    assert text(spark, lambda c: fmt.fixed(c, 2), value) == f"{value:.2f}"


def test_labels_and_links(spark):
    assert [text(spark, fmt.ma_label, s, "string") for s in ("pass", "fail", "omitted", None)] == ["Yes", "No", "Omit", "N/A"]
    assert text(spark, fmt.chart_url, "BHP.AX", "string").endswith("=ASX:BHP")
    assert text(spark, fmt.chart_url, "IBM", "string").endswith("=IBM")
    assert text(spark, fmt.quote_url, "IBM", "string").endswith("/quote/IBM")


def test_suffix(spark):
    assert text(spark, fmt.with_suffix, "CBA", "string") == "CBA.AX"
    assert text(spark, fmt.with_suffix, "CBA.AX", "string") == "CBA.AX"
    assert fmt.detect_suffix("/lists/ASX_200.txt") == ".AX" and fmt.detect_suffix("us.txt") is None
    assert fmt.detect_suffix("my.ax.txt") is None and fmt.detect_suffix("my.ax.txt", "scan") == ".AX"
    assert fmt.detect_suffix("asx/nasdaq_screener_list.txt", "scan") is None


def test_order_of_results(spark):
    rows = [("B", "2024-01-01", 1.0, None, 1.0, 2.5), ("A", "2024-01-01", 9.0, None, 1.0, 2.5), ("C", "2024-01-01", 5.0, None, 1.0, 10.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, close_price double, market_cap double, avg_volume double, volume_ratio double")
    assert [r.ticker for r in bs.rank_results(df).collect()] == ["C", "A", "B"]
    assert [r.ticker for r in bs.sort_results(df, "close_price").collect()] == ["B", "C", "A"]
    assert [r.ticker for r in bs.sort_results(df, "volume_ratio", ascending=False).collect()] == ["C", "A", "B"]
    shown = bs.to_display(df).filter("ticker = 'C'").first()
    assert (shown.close_price, shown.market_cap, shown.avg_volume, shown.volume_ratio) == ("5.00", "N/A", "1", "10.00x")
