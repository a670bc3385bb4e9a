"""Bars and company info from tables of other shapes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.cleaning import clean_number


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bars_from_table(
    df: DataFrame,
    symbol: Column | str,
    ts: Column | str,
    close: Column | str,
    volume: Column | str,
    open: Column | str | None = None,
    high: Column | str | None = None,
    low: Column | str | None = None,
    tiebreak: Column | list | None = None,
) -> DataFrame:
    """Canonical bars from any table with a symbol, time, price and volume.

    Prices that are not named repeat ``close``. Rows of one instant need a
    ``tiebreak``: a list of columns, or one sortable column that already leads
    with the time (see ``packed_order``), which aggregates faster.
    """
    if tiebreak is None:
        order = _col(ts)
    elif isinstance(tiebreak, (list, tuple)):
        order = F.struct(_col(ts).alias("ts"), *[_col(t).alias(f"t{i}") for i, t in enumerate(tiebreak)])
    else:
        order = _col(tiebreak)
    price = clean_number(_col(close))
    return df.select(
        _col(symbol).cast("string").alias("symbol"),
        F.to_date(_col(ts)).alias("session_date"),
        order.alias("bar_order"),
        *[
            (price if c is None else clean_number(_col(c))).alias(name)
            for name, c in (("open", open), ("high", high), ("low", low), ("close", None))
        ],
        clean_number(_col(volume)).alias("volume"),
    )


def checked_bars(
    df: DataFrame,
    symbol: Column | str,
    ts: Column | str,
    close: Column | str,
    volume: Column | str,
    open: Column | str | None = None,
    high: Column | str | None = None,
    low: Column | str | None = None,
) -> DataFrame:
    """Bars from a table whose cells may be anything: a row that is no bar doesn't end the run, but gets a ``reason``.

    Reasons, the first that holds: ``no symbol``, ``no date``, ``<field> is no number`` (a cell that holds something
    else), ``no figures``. ``reason`` is null for bars, ``given`` has a rejected row as JSON. Null cells, empty text
    and NaN are missing figures. ``save_bars`` stores both kinds in one pass.
    """
    text = lambda c: F.nullif(F.trim(_col(c).cast("string")), F.lit(""))
    fields = dict(zip(K.OHLCV, (open or close, high or close, low or close, close, volume)))
    number = {name: text(c).try_cast("double") for name, c in fields.items()}
    held = {name: F.nanvl(n, F.lit(None)) for name, n in number.items()}
    day = F.coalesce(_col(ts).try_cast("timestamp_ntz").cast("date"), _col(ts).try_cast("date"))
    checks = [(text(symbol).isNull(), "no symbol"), (day.isNull(), "no date")]
    named = {"close": close, "volume": volume, "open": open, "high": high, "low": low}
    checks += [(text(c).isNotNull() & number[name].isNull(), f"{name} is no number") for name, c in named.items() if c is not None]
    nothing = F.coalesce(*held.values()).isNull()
    reason = F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in [*checks, (nothing, "no figures")]])
    given = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.select(
        text(symbol).alias("symbol"), day.alias("session_date"), *[c.alias(name) for name, c in held.items()],
        reason.alias("reason"), F.when(reason.isNotNull(), given).alias("given"),
    )


def save_bars(checked: DataFrame, path: str) -> None:
    """Store bars and, beside them, the rows of ``checked_bars`` that are none: one pass, one table of two folders."""
    checked.withColumn("rejected", F.col("reason").isNotNull()).write.partitionBy("rejected").parquet(path)


def read_bars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The bars of ``save_bars``, and the rejected rows (symbol, reason, given); each reads its folder alone."""
    kinds = "symbol string, session_date date, " + ", ".join(f"{c} double" for c in K.OHLCV) + ", reason string, given string, rejected boolean"
    stored = spark.read.schema(kinds).parquet(path)
    return stored.where(~F.col("rejected")).select("symbol", "session_date", *K.OHLCV), stored.where("rejected").select("symbol", "reason", "given")


def bars_from_wide(df: DataFrame, sep: str = "|", date: str = "session_date") -> DataFrame:
    """Long bars from a frame with one ``SYMBOL|Field`` column per symbol and field.

    Each wide row unfolds where it is, without a shuffle: its cells are one array, and a header says at which places
    a symbol's fields stand. The plan has one expression for all symbols, however many columns there are. A field
    that a symbol lacks is null, and so is NaN.
    """
    places: dict[str, dict[str, int]] = {}
    cells: list[str] = []
    for name in df.columns:
        symbol, mark, field = name.rpartition(sep)
        if mark and field in K.HISTORY_FIELDS:
            places.setdefault(symbol, {})[field] = len(cells)
            cells.append("CAST(`{}` AS DOUBLE)".format(name.replace("`", "``")))
    if not places:
        raise ValueError(f"no column is named like 'SYMBOL{sep}Close'")
    header = [{"symbol": symbol, "at": [found.get(field, -1) for field in K.HISTORY_FIELDS]} for symbol, found in places.items()]
    # one literal, which Spark reads when it plans
    listed = F.from_json(F.lit(json.dumps(header)), "array<struct<symbol: string, at: array<int>>>")
    rows = df.select(F.col(date).cast("date").alias("session_date"), F.expr(f"array({', '.join(cells)})").alias("cells"))
    unfolded = rows.select("session_date", "cells", F.explode(listed).alias("h"))
    bars = [clean_number(F.get("cells", F.get("h.at", F.lit(k)))).alias(target) for k, target in enumerate(K.OHLCV)]
    return unfolded.select("h.symbol", "session_date", *bars)


def info_from_table(df: DataFrame, symbol: Column | str, market_cap: Column | str, price: Column | str) -> DataFrame:
    """Company info (market cap and market price) from any table."""
    return df.select(
        _col(symbol).cast("string").alias("symbol"),
        clean_number(_col(market_cap)).alias("market_cap"),
        clean_number(_col(price)).alias("regular_market_price"),
    )
