"""Text of symbols, figures and links, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Characters that trimming removes from both ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def with_suffix(c: Column | str, suffix: str = K.SUFFIX_ASX) -> Column:
    """Append an exchange suffix to symbols that lack it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def detect_suffix(path: str, mode: str = "fetch") -> str | None:
    """The suffix that a symbol list needs, judged by its path."""
    name = path.lower()
    if mode == "scan":
        listed = (".ax" in name or "asx" in name) and K.US_LIST_NAME not in name
    elif mode == "fetch":
        listed = "asx" in name
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return K.SUFFIX_ASX if listed else None


def fixed(c: Column, places: int) -> Column:
    """A number with ``places`` decimals and no thousands separators."""
    return F.translate(F.format_number(c, places), ",", "")


def format_market_cap(c: Column | str, dialect: str = "live") -> Column:
    """Market cap with its unit. Below a million only ``live`` names the unit."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.when(c.isNull(), F.lit("N/A"))
    text = text.when(c >= 1e9, F.concat(fixed(c / 1e9, 2), F.lit("B")))
    text = text.when(c >= 1e6, F.concat(fixed(c / 1e6, 2), F.lit("M")))
    if dialect == "live":
        return text.when(c >= 1e3, F.concat(fixed(c / 1e3, 2), F.lit("K"))).otherwise(fixed(c, 0))
    return text.otherwise(fixed(c / 1e3, 0))


def ma_label(c: Column | str) -> Column:
    """Reader's word for a moving-average state."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.when(c.isNull(), F.lit(K.MA_LABEL_ABSENT))
    for state, label in K.MA_LABELS.items():
        text = text.when(c == state, F.lit(label))
    return text.otherwise(F.lit(K.MA_LABEL_ABSENT))


def quote_url(c: Column | str) -> Column:
    return F.concat(F.lit(K.QUOTE_URL), F.col(c) if isinstance(c, str) else c)


def chart_symbol(c: Column | str) -> Column:
    """Symbol as charting sites write it: the exchange comes first."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.substring(c, F.lit(1), F.length(c) - len(K.SUFFIX_ASX))
    return F.when(c.endswith(K.SUFFIX_ASX), F.concat(F.lit(K.CHART_EXCHANGE_ASX), bare)).otherwise(c)


def chart_url(c: Column | str) -> Column:
    return F.concat(F.lit(K.CHART_URL), chart_symbol(c))
