"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space that separates words: U+0009 to U+000D and U+0020.
WHITE = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that go to a Python worker at a time; texts may be long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, an array; null and empty texts have none."""
    plain = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(plain, " "), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps don't compute it anew.

    The files outlive any executor, and their sizes let Spark choose its joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: batches of at most ``ARROW_ROWS`` rows, and 16 MB where Spark can limit bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def without(df: DataFrame, *names: str) -> str:
    """A column name that ``df`` lacks, from the wanted names joined."""
    name = "_".join(names)
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
