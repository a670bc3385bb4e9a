"""A screen that counts while it runs: how many symbols it looked at and how many matched, from the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions.predicates import market_cap_between
from ..operators import judging
from ..operators.quality import one_info_per_symbol
from ..operators.records import to_rich, to_slim
from .dialects import dialect_of


def observed_screen(
    weekly: DataFrame, info: DataFrame, config: ScreenConfig, dialect: str = "lookback", as_of=None, symbols: DataFrame | None = None
) -> tuple[DataFrame, Observation]:
    """The records of ``screen``, unordered, and an observation of its run with ``matched`` and ``total`` symbols.

    The numbers are those of ``screen_summary``: of all symbols of ``weekly``, or of the listed ``symbols``, each
    once. They are there (``observation.get``) after the first action on the records, from that very run; progress
    of a stream shows them as well. Order records afterwards (``rank_results``): a sort in the same plan looks at its
    input twice, and would count it twice.
    """
    rules = dialect_of(dialect)
    if rules.validates:
        config.validate()
    rows = judging.judged_and_rejected(weekly, config, rules, as_of)
    hit = F.col("finished") & judging.all_conditions()
    fields = [c for c in rows.columns if c not in ("symbol", "finished", "usable", *judging.CONDITIONS)]
    facts = rows.groupBy("symbol").agg(F.min_by(F.struct(*fields), F.when(hit, F.col("age"))).alias("match"))
    if symbols is not None:
        facts = symbols.select("symbol").distinct().join(facts, "symbol", "left")
    known = one_info_per_symbol(info).select("symbol", "market_cap", F.lit(True).alias("has_info"))
    ok = F.col("match").isNotNull() & market_cap_between(config.min_market_cap, config.max_market_cap)
    if rules.info_required:
        ok = ok & F.col("has_info").isNotNull()
    observation = Observation()
    counted = facts.join(known, "symbol", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
    counted = counted.observe(observation, F.count_if("ok").alias("matched"), F.count(F.lit(1)).alias("total"))
    found = counted.where("ok").select("symbol", "match.*", "market_cap")
    return (to_rich(found, config) if rules.rich else to_slim(found)), observation
