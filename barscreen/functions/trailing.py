"""Means over the rows before the current one.

A frame of ``n`` rows that slides one row at a time is re-summed by Spark for every row, which costs rows x n. That is
``method='frames'``, which needs nothing else. ``method='prefix'`` subtracts two running sums, so its cost doesn't depend
on ``n``; the screens use it. Running sums of doubles would lose precision by the subtraction, and a series of equal
prices must have exactly that price as its mean, or rounding would decide the strict comparison with the mean. So
``scaled`` gives each value its decimal digits as ``decimal(38,20)``, and these are summed. Where all values of a symbol
lie between 1e-3 and 1e12, as prices and volumes do, that is a cast. Others are shifted by a power of ten that brings
the symbol's largest one below 1e12, and their means are shifted back. So values of any size are taken. Beside a symbol's
largest value, others keep all their digits down to 1e-15 of it, and lose the last of them below that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_PERIOD_FRACTION

# One symbol's weeks, oldest first. Every window of a screen uses this.
SYMBOL_WEEKS = "PARTITION BY symbol ORDER BY week_end"

# Values are below 10 to LARGEST: six integer digits more serve a million weeks of a symbol.
EXACT, LARGEST, SMALLEST = "DECIMAL(38, 20)", 12, -3


def scaled(weeks: DataFrame, columns: tuple[str, ...] = ("close", "volume"), window: str = SYMBOL_WEEKS) -> DataFrame:
    """``weeks`` with ``<column>_power``, a symbol's power of ten (mostly 0), and ``<column>_exact``, its values shifted by that.

    The power is a window of the same order as the means', so it neither shuffles nor sorts anew.
    """
    whole = f"OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

    def power(c: str) -> Column:
        size = f"CASE WHEN abs({c}) < double('infinity') THEN nullif(abs({c}), 0D) END"
        high, low = f"max({size}) {whole}", f"min({size}) {whole}"
        plain = f"{high} IS NULL OR ({high} < 1e{LARGEST} AND {low} >= 1e{SMALLEST})"
        return F.expr(f"CASE WHEN {plain} THEN 0 ELSE CAST(ceil(log10({high})) AS INT) - {LARGEST} END")

    powers = {f"{c}_power": power(c) for c in columns}
    return weeks.withColumns(powers).withColumns({f"{c}_exact": F.expr(_shifted(c)) for c in columns})


def _shifted(c: str) -> str:
    """SQL: the digits of a number by its shortest text, which names it uniquely, with another exponent.

    A cast takes the same digits, without the text."""
    text = f"CAST(CAST({c} AS DOUBLE) AS STRING)"
    exponent = f"CASE WHEN instr({text}, 'E') > 0 THEN CAST(substring_index({text}, 'E', -1) AS INT) ELSE 0 END"
    shifted = f"try_cast(concat(substring_index({text}, 'E', 1), 'E', {exponent} - {c}_power) AS {EXACT})"
    return f"CASE WHEN {c}_power = 0 THEN try_cast(CAST({c} AS DOUBLE) AS {EXACT}) ELSE {shifted} END"


def without_scales(weeks: DataFrame, columns: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    return weeks.drop(*[f"{c}{end}" for c in columns for end in ("_power", "_exact")])


def trailing_mean(
    c: str,
    n: int,
    min_frac: float = MIN_PERIOD_FRACTION,
    *,
    method: str = "frames",
    window: str = SYMBOL_WEEKS,
) -> Column:
    """Mean of the ``n`` rows before this one; null below ``int(n * min_frac)`` values.

    ``c`` is a column. ``method='frames'`` sums each frame afresh; ``'prefix'`` needs the columns of ``scaled``.
    """
    if n <= 0:
        return F.lit(None).cast("double")
    needed = max(int(n * min_frac), 1)
    if method == "frames":
        over = f"OVER ({window} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        low, high = f"min({c}) {over}", f"max({c}) {over}"
        mean = f"CASE WHEN {low} = {high} THEN {high} ELSE avg({c}) {over} END"
        return F.expr(f"CASE WHEN count({c}) {over} >= {needed} THEN {mean} END")
    if method != "prefix":
        raise ValueError(f"unknown method {method!r}")
    before = f"OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    outside = f"OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND {n + 1} PRECEDING)"
    count = f"(count({c}) {before} - count({c}) {outside})"
    total = f"(sum({c}_exact) {before} - coalesce(sum({c}_exact) {outside}, 0))"
    endless = f"(sum({endless_of(c)}) {before} - coalesce(sum({endless_of(c)}) {outside}, 0))"
    mean = f"CASE WHEN {endless} = 0 THEN {_unshifted(c, total, count)} ELSE {endless_mean(endless)} END"
    return F.expr(f"CASE WHEN {count} >= {needed} THEN {mean} END")


#: What a value of minus infinity adds to a count of infinite values; one of plus infinity adds 1.
DOWNWARD = 1 << 32


def endless_of(c: str) -> str:
    """SQL of an infinite value's part in their count. Such values can't be summed exactly; a frame's mean follows from the count."""
    return f"CASE {c} WHEN double('infinity') THEN 1L WHEN double('-infinity') THEN {DOWNWARD}L ELSE 0L END"


def endless_mean(endless: str) -> str:
    """SQL of the mean of values some of which are infinite: NaN if there are both kinds, as in a sum of doubles."""
    kind = f"CASE WHEN {endless} < {DOWNWARD}L THEN 'infinity' WHEN {endless} % {DOWNWARD}L = 0 THEN '-infinity' ELSE 'nan' END"
    return f"CAST({kind} AS DOUBLE)"


def _unshifted(c: str, total: str, count: str) -> str:
    mean = f"{total} / {count}"
    return f"CASE WHEN {c}_power = 0 THEN CAST({mean} AS DOUBLE) ELSE CAST(concat(CAST({mean} AS STRING), 'E', {c}_power) AS DOUBLE) END"


def preceding_mean(c: str, n: int, **options) -> Column:
    """Plain mean of the ``n`` rows before this one; null unless there are ``n``."""
    window = options.get("window", SYMBOL_WEEKS)
    before = F.expr(f"count(1) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return F.when(before >= n, trailing_mean(c, n, 0.0, **options))


def avg_volume(weeks: int, **options) -> Column:
    """Average weekly volume before this week."""
    return trailing_mean("volume", weeks, **options)


def moving_averages(periods: dict[str, int], c: str = "close", prefix: str = "ma_", **options) -> list[Column]:
    """One trailing mean per named period. Select them together: one sort serves all."""
    return [trailing_mean(c, n, **options).alias(f"{prefix}{name}") for name, n in periods.items()]


def bar_position(window: str = SYMBOL_WEEKS) -> Column:
    """Number of weeks before this one."""
    return F.expr(f"row_number() OVER ({window}) - 1")


def bar_age(window: str = SYMBOL_WEEKS, counted: str = "1") -> Column:
    """1 for the newest week of a symbol, 2 for the week before, and so on.

    ``counted`` is the SQL of what is null for rows that do not count as weeks.
    """
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return F.expr(f"CAST(count({counted}) OVER ({window} {whole}) AS INT) - row_number() OVER ({window}) + 1")


def volume_ratio(volume: Column | str = "volume", average: Column | str = "avg_volume") -> Column:
    """Volume relative to its average; infinite for an average of zero."""
    volume = F.col(volume) if isinstance(volume, str) else volume
    average = F.col(average) if isinstance(average, str) else average
    return F.when(average > 0, volume / average).when(average <= 0, F.lit(float("inf")))
