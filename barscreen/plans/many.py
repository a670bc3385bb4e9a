"""Many saved screens over one pass of the weekly table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig, configs_from_settings
from ..functions import predicates as P
from ..functions.trailing import preceding_mean, trailing_mean
from ..operators import judging
from ..operators.quality import attach_info, listed, repeated
from .dialects import Dialect, dialect_of

#: Screens whose conditions share one pass; more of them take as many passes as they need.
SCREENS_PER_PASS = 100


def screen_many(
    weekly: DataFrame,
    info: DataFrame,
    configs: dict[str, ScreenConfig] | DataFrame,
    dialect: str = "lookback",
    as_of=None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Records of many screens, tagged ``config_id``: rich for ``live``, else slim.

    Each distinct period is computed once in a pass. Every judged week is tested against all screens in place, by
    generated code: no join, and only matches become rows. Two screens of one id are refused.
    """
    rules = dialect_of(dialect)
    named = configs_from_settings(configs) if isinstance(configs, DataFrame) else list(configs.items())
    if not named:
        raise ValueError("no screens given")
    twice = sorted({i for i, _ in named if sum(i == j for j, _ in named) > 1}) if len({i for i, _ in named}) < len(named) else []
    if twice:
        raise ValueError(f"several screens are named {twice}")
    if rules.validates:
        for _, config in named:
            config.validate()
    if symbols is not None:
        weekly = listed(weekly, symbols)
    groups = [named[k : k + SCREENS_PER_PASS] for k in range(0, len(named), SCREENS_PER_PASS)]
    found = reduce(DataFrame.unionByName, [_one_pass(weekly, info, group, rules, as_of) for group in groups])
    if rules.keeps_repeats and symbols is not None:
        found = repeated(found, symbols, "ticker")
    return found


def _one_pass(weekly: DataFrame, info: DataFrame, named: list[tuple[str, ScreenConfig]], rules: Dialect, as_of) -> DataFrame:
    def means(kind: str, mean, column: str, periods) -> list[Column]:
        return [mean(column, n, method="prefix").alias(f"{kind}_{n}") for n in sorted(set(periods))]

    columns = [
        *means("volume", trailing_mean, "volume", (c.avg_volume_weeks for _, c in named)),
        *means("recent", preceding_mean, "close", (c.price_avg_weeks for _, c in named)),
        *means("average", trailing_mean, "close", (n for _, c in named for n in c.ma_periods.values())),
    ]
    weeks = judging.judged_weeks(
        judging.finished_weeks(weekly, as_of),
        columns,
        max(rules.lookback(c) for _, c in named),
        max(judging.longest_frame(c) for _, c in named),
    ).filter(judging.recent_enough(rules, as_of))
    weeks = attach_info(weeks, info, "inner" if rules.info_required else "left")
    hits = F.array_compact(F.array(*[F.when(_matches(c, rules), _record(i, c, rules)) for i, c in named]))
    hits = weeks.select("symbol", "week_end", "age", "close", "volume", "market_cap", F.explode(hits).alias("hit"))
    picked = judging.newest_match(hits.select("*", "hit.config_id"), ("symbol", "config_id"))
    return picked.select(
        "config_id",
        F.col("symbol").alias("ticker"),
        F.col("week_end").cast("string").alias("date"),
        F.col("close").alias("close_price"),
        "market_cap",
        F.col("hit.avg_volume").alias("avg_volume"),
        (F.col("volume") / F.col("hit.avg_volume")).alias("volume_ratio"),
        *(["volume", "hit.ma_values", "hit.ma_passes", "hit.ma_periods"] if rules.rich else []),
    )


def _state(n: int) -> Column:
    return P.ma_state(n, f"average_{n}")


def _record(config_id: str, c: ScreenConfig, rules: Dialect) -> Column:
    """What a match of one screen reports; worked out for matches alone."""
    fields = [F.lit(config_id).alias("config_id"), F.col(f"volume_{c.avg_volume_weeks}").alias("avg_volume")]
    if rules.rich:

        def by_name(value) -> Column:
            return F.create_map(*[x for k, n in c.ma_periods.items() for x in (F.lit(k), value(n))])

        fields += [
            by_name(lambda n: F.when(_state(n) != "omitted", F.col(f"average_{n}"))).alias("ma_values"),
            by_name(_state).alias("ma_passes"),
            by_name(F.lit).alias("ma_periods"),
        ]
    return F.struct(*fields)


def _matches(c: ScreenConfig, rules: Dialect) -> Column:
    """All conditions of one screen on the current week."""
    return (
        (F.col("age") <= rules.lookback(c))
        & P.old_enough(
            c.ma_short,
            c.ma_intermediate,
            c.avg_volume_weeks,
            extra_weeks=rules.extra_weeks,
            gate_intermediate=rules.gate_intermediate,
        )
        & P.volume_spike(c.volume_multiplier, "volume", f"volume_{c.avg_volume_weeks}")
        & P.price_above_recent(c.price_avg_weeks, rules.zero_window_passes, "close", f"recent_{c.price_avg_weeks}")
        & P.all_ma_hold([_state(n) for n in c.ma_periods.values()])
        & P.market_cap_between(c.min_market_cap, c.max_market_cap)
    )
