"""Null handling, dates and sort keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WEEK_END_DAY


def clean_number(c: Column | str) -> Column:
    """A double where NaN has become null, so that comparisons reject it."""
    return F.nanvl(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), F.lit(None))


def week_end(date: Column | str, day: str = WEEK_END_DAY) -> Column:
    """Label of the week a date falls in: the first ``day`` on or after it."""
    return F.next_day(F.date_sub(date, 1), day)


def iso_session_date(text: Column, exchange_tz: str) -> Column:
    """Exchange-local date of an ISO time. A time without zone is local already."""
    zoned = F.try_to_timestamp(text)
    local = F.convert_timezone(None, F.lit(exchange_tz), zoned.cast("timestamp_ntz"))
    has_zone = text.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, F.to_date(local)).otherwise(F.try_to_date(F.substring(text, 1, 10)))


def utc_instant(wall_clock: Column) -> Column:
    """The instant at which a UTC clock shows ``wall_clock`` (a zone-less time).

    Event-time watermarks need instants. Unlike a cast this does not depend on
    the time zone of the session.
    """
    return F.make_timestamp_ltz(
        F.year(wall_clock),
        F.month(wall_clock),
        F.dayofmonth(wall_clock),
        F.hour(wall_clock),
        F.minute(wall_clock),
        F.date_part(F.lit("SECOND"), wall_clock),
        F.lit("UTC"),
    )


def utc_date(instant: Column) -> Column:
    """Date of an instant on a UTC clock, whatever the zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def packed_order(*parts: tuple[str, int]) -> Column:
    """One decimal that sorts like the tuple of ``parts``.

    Each part is ``(SQL of a non-negative integer, digits)``; see ``DAY_NUMBER``
    for dates. All digits together must fit 38. Spark keeps a decimal in a
    fixed-width aggregation buffer, so ``max_by`` over it stays a hash
    aggregate, while a struct key makes it sort every row. A value outside its
    digits fails the job instead of sorting wrongly.
    """
    if sum(digits for _, digits in parts) > 38:
        raise ValueError("a packed order key holds at most 38 digits")
    words: list[tuple[str, int]] = []  # neighbouring parts that fit one long
    for part, digits in parts:
        checked = (
            f"CASE WHEN {part} BETWEEN 0 AND {10**digits - 1} OR {part} IS NULL THEN CAST({part} AS BIGINT) "
            f"ELSE CAST(raise_error('order key part outside {digits} digits') AS BIGINT) END"
        )
        if words and words[-1][1] + digits <= 18:
            text, held = words.pop()
            words.append((f"({text}) * {10**digits}L + ({checked})", held + digits))
        else:
            words.append((checked, digits))
    terms, below = [], 0
    for text, digits in reversed(words):
        number = f"CAST({text} AS DECIMAL({digits}, 0))"
        terms.append(f"{number} * CAST('1{'0' * below}' AS DECIMAL({below + 1}, 0))" if below else number)
        below += digits
    return F.expr(f"CAST({' + '.join(terms)} AS DECIMAL(38, 0))")


# Days since 0001-01-01: a non-negative integer of at most 7 digits.
DAY_NUMBER = "datediff({date}, DATE'0001-01-01')"
