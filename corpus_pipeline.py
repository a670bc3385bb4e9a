"""The corpus pipeline: documents in, packed training sequences out, one stage after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.llm.common import stored, table
from barscreen.llm.mixing import mix_sources
from barscreen.llm.packing import pack_documents, vocabulary
from barscreen.llm.pii import find_personal_data
from barscreen.llm.quality_rules import quality_rules, trusted_ids
from barscreen.llm.simhash import survivors


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator needs, and whole rows in one more: no column can clash with the operator's."""
    return docs.select(*columns, F.struct(*docs.columns).alias("whole_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules(whole(docs, "doc_id", "text"), trusted_ids(table(spark, sf_dir, "labels")))
    # the verdict is a long expression: a row number in it keeps Spark from working it out in a filter and again after it
    verdict = F.when(F.monotonically_increasing_id() >= 0, F.col("kept")).alias("verdict")
    return judged.select("whole_row", verdict).where("verdict").select("whole_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return survivors(whole(docs, "doc_id", "text")).select("whole_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    names = docs.columns
    found = find_personal_data(whole(docs, "text"))
    changed = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted"), F.lit(0)).cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col("whole_row")[c].alias(c) for c in names])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole ones only."""
    mixed = mix_sources(whole(docs, "doc_id", "text", "source"), whole=True)
    repeated = mixed.where("copies > 0").select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("whole_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_copies), ("PII", personal_data), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
