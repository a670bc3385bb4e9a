"""Why symbols were skipped, and how many were not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions.formatting import fixed
from ..functions.predicates import market_cap_between
from ..operators import judging
from ..operators.quality import one_info_per_symbol
from .dialects import Dialect, dialect_of

MATCHED = "matched"


def explain_screen(
    weekly: DataFrame,
    info: DataFrame,
    config: ScreenConfig,
    dialect: str = "lookback",
    as_of=None,
    symbols: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol: ``matched`` or the first reason it was skipped, with detail.

    ``weekly`` is the table before any week is dropped. ``symbols`` defaults to
    the symbols in it; ``errors`` are unreadable records of a snapshot.
    """
    rules = dialect_of(dialect)
    if rules.validates:
        config.validate()
    newest, counts = F.col("age") == 1, F.col("finished")
    facts = (
        judging.judged_and_rejected(weekly, config, rules, as_of)
        .groupBy("symbol")
        .agg(
            F.bool_or("usable").alias("any_usable"),
            F.bool_or(counts).alias("any_finished"),
            F.max(F.when(newest, F.col("bars_before"))).alias("bars_before"),
            F.max(F.when(newest, F.col("week_end"))).alias("last_week"),
            F.max(F.when(newest, F.col("is_recent"))).alias("is_recent"),
            F.count_if(counts).alias("n_judged"),
            F.count_if(counts & F.col("is_spike")).alias("n_spikes"),
            F.count_if(counts & F.col("is_rising")).alias("n_rising"),
            F.count_if(counts & F.col("is_above_averages")).alias("n_above"),
            F.coalesce(F.bool_or(counts & judging.all_conditions()), F.lit(False)).alias("is_match"),
        )
    )
    if symbols is not None:
        facts = symbols.select("symbol").distinct().join(facts, "symbol", "left")
    known = one_info_per_symbol(info).select("symbol", "market_cap", F.lit(True).alias("has_info"))
    facts = facts.join(known, "symbol", "left")
    if errors is not None:
        messages = errors.groupBy("symbol").agg(F.min("message").alias("message"))
        facts = facts.join(messages, "symbol", "left")
    else:
        facts = facts.withColumn("message", F.lit(None).cast("string"))
    first_step = F.coalesce(
        *[
            F.when(condition, F.struct(F.lit(name).alias("reason"), text.alias("detail")))
            for name, condition, text in _steps(config, rules)
        ]
    )
    return facts.select("symbol", first_step.alias("step")).select("symbol", "step.reason", "step.detail")


def _steps(config: ScreenConfig, rules: Dialect) -> list[tuple[str, Column, Column]]:
    cap, before = F.col("market_cap"), F.col("bars_before")
    nothing = F.lit(None).cast("string")
    match = F.coalesce("is_match", F.lit(False))
    cap_text = F.concat(fixed(cap / 1_000_000, 2), F.lit("M"))
    cap_steps = [
        ("cap_missing", cap.isNull() & F.lit(config.min_market_cap > 0), nothing),
        (
            "cap_below_min",
            cap.isNotNull() & ~market_cap_between(config.min_market_cap, 0),
            cap_text,
        ),
        ("cap_above_max", cap.isNotNull() & ~market_cap_between(0, config.max_market_cap), cap_text),
    ]
    if not rules.cap_first:
        cap_steps = [(name, match & condition, text) for name, condition, text in cap_steps]
    history = ("missing_history", F.col("any_usable").isNull(), nothing)
    steps = [("error", F.col("message").isNotNull(), F.col("message"))]
    if rules.info_required:
        steps.append(("missing_info", F.col("has_info").isNull(), nothing))
    steps += [*cap_steps, history] if rules.cap_first and not rules.info_required else [history]
    if rules.info_required:
        steps += cap_steps
    steps += [
        ("no_valid_weeks", ~F.col("any_usable"), nothing),
        ("no_finished_weeks", ~F.col("any_finished"), nothing),
        ("no_recent_data", ~F.col("is_recent"), F.col("last_week").cast("string")),
        ("too_young_short", before < config.ma_short + rules.extra_weeks, F.lit(f"{config.ma_short} weeks")),
    ]
    if rules.gate_intermediate:
        steps.append(
            ("too_young_intermediate", before < config.ma_intermediate, F.lit(f"{config.ma_intermediate} weeks"))
        )
    steps.append(
        (
            "too_young_volume",
            before < config.avg_volume_weeks + rules.extra_weeks,
            F.lit(f"{config.avg_volume_weeks} weeks"),
        )
    )
    if not rules.cap_first:
        steps += cap_steps
    counts = F.format_string(
        "of %d weeks judged, %d spiked, %d rose, %d held their averages", "n_judged", "n_spikes", "n_rising", "n_above"
    )
    return [*steps, (MATCHED, match, nothing), ("no_week_matched", F.lit(True), counts)]


def screen_summary(explained: DataFrame) -> DataFrame:
    """One row: how many symbols matched, of how many."""
    return explained.agg(
        F.count_if(F.col("reason") == MATCHED).alias("matched"), F.count(F.lit(1)).alias("total")
    )
