"""Symbol lists: text files in, tables in, text files out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.formatting import trimmed, with_suffix


def read_symbols(spark: SparkSession, path: str, mode: str = "fetch", suffix: str | None = None) -> DataFrame:
    """Symbols of a text list, one row per entry, repeats included.

    ``fetch`` treats the first line of a file as its header if it holds both
    header words, skips a bare ``Symbol`` and gives every entry the suffix.
    ``scan`` skips the first line with the joined header words and gives the
    suffix only to entries that are not ``|``-delimited.
    """
    if mode not in ("fetch", "scan"):
        raise ValueError(f"unknown mode {mode!r}")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        trimmed("value").alias("text"),
    )
    body = _without_header(lines, mode).filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    delimited = F.col("text").contains("|")
    entry = F.upper(trimmed(F.split("text", r"\|", 2)[0]))
    entries = body.select(entry.alias("symbol"), delimited.alias("delimited")).filter(F.col("symbol") != "")
    if mode == "fetch":
        entries = entries.filter(F.col("symbol") != K.HEADER_SYMBOL)
    if suffix:
        keep = F.col("delimited") if mode == "scan" else F.lit(False)
        entries = entries.withColumn("symbol", F.when(keep, F.col("symbol")).otherwise(with_suffix("symbol", suffix)))
    return entries.select("symbol")


def _without_header(lines: DataFrame, mode: str) -> DataFrame:
    """Drop each file's header, found by position without sorting the lines.

    Only lines that hold the header's words can be one, so only these are joined; all others pass as they are.
    """
    text, place = F.col("text"), F.struct("block", "line")
    if mode == "fetch":
        can_be = reduce(lambda a, b: a & b, [text.contains(w) for w in K.LIST_HEADER_WORDS])
        first = lines.filter(F.col("block") == 0)
    else:
        can_be = text.contains(K.LIST_HEADER) & ~text.startswith("#") & reduce(lambda a, b: a & b, [text.contains(w) for w in K.LIST_HEADER_WORDS])
        first = lines.filter(text.contains(K.LIST_HEADER) & ~text.startswith("#"))
    header = first.groupBy("file").agg(F.min(place).alias("place")).select("file", "place.block", "place.line")
    return lines.filter(~can_be).unionByName(lines.filter(can_be).join(header, ["file", "block", "line"], "left_anti"))


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.dropDuplicates(["symbol"])


def symbols_from_table(table: DataFrame, name_contains: str = "code") -> DataFrame:
    """Symbols of the first column whose name contains ``name_contains``."""
    for name in table.columns:
        if name_contains in name.lower():
            cell = F.upper(trimmed(F.col(f"`{name}`").cast("string")))
            return table.select(cell.alias("symbol")).filter(F.col("symbol").isNotNull())
    raise ValueError(f"no column name contains {name_contains!r}: {table.columns}")


def write_symbols(symbols: DataFrame, path: str) -> None:
    """Save a list: a ``Symbol`` header, then one symbol per line, in part files."""
    symbols.select(F.col("symbol").alias("Symbol")).write.csv(
        path, header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
