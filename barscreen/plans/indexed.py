"""Any number of saved screens, as a table, in one pass: an index of thresholds takes the place of a plan per screen.

Screens of the same periods differ only in numbers that a week's figures are compared with. They form a group, sorted by
volume multiplier. A symbol's running sums stand in an array by week, so the mean over any period, which the plan
needn't know, is a difference of two elements. Each judged week gets the means of all periods once, tests what a group
has in common once, and finds by binary search how many of the group's multipliers its volume reaches.

Settings reach the tasks as one value of the plan, read from their table when it runs: nothing is collected or written
into the plan, whose size is the same for one screen and for thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_PERIOD_FRACTION
from ..functions import predicates as P
from ..functions.trailing import DOWNWARD, EXACT, SYMBOL_WEEKS, endless_of, scaled
from ..operators import judging
from ..operators.quality import attach_info, listed, repeated
from .dialects import Dialect, dialect_of

PERIODS = {"volume": "avg_volume_weeks", "recent": "price_avg_weeks", "short": "ma_short", "intermediate": "ma_intermediate", "medium": "ma_medium", "long": "ma_long"}
AVERAGES = ("short", "intermediate", "medium", "long")


def _checked(settings: DataFrame, rules: Dialect) -> DataFrame:
    """Settings whose ids are unique and, where the dialect validates them, whose figures are valid; else the job fails."""
    fields = [c for c in settings.columns if c != "config_id"]
    once = settings.groupBy("config_id").agg(F.count(F.lit(1)).alias("times"), F.first(F.struct(*fields)).alias("s"))
    refuse = lambda ok, why: F.when(ok, F.col("config_id")).otherwise(F.raise_error(F.concat(F.lit(why), F.col("config_id"))))
    checked = once.withColumn("config_id", refuse(F.col("times") == 1, "several screens are named "))
    if rules.validates:
        s = lambda name: F.col("s")[name]
        caps = (s("min_market_cap") >= 0) & (s("max_market_cap") >= 0) & ~((s("max_market_cap") > 0) & (s("max_market_cap") < s("min_market_cap")))
        periods = (s("ma_short") > 0) & (s("ma_short") < s("ma_intermediate")) & (s("ma_intermediate") < s("ma_medium")) & (s("ma_medium") < s("ma_long"))
        checked = checked.withColumn("config_id", refuse(caps & periods & (s("volume_multiplier") > 0), "invalid settings of "))
    return checked.select("config_id", "s.*")


def _index(settings: DataFrame, rules: Dialect) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-row tables: all periods in order, the groups of screens, and the longest lookback."""
    given = _checked(settings, rules)
    lookback = F.col("lookback_weeks") if rules.looks_back else F.lit(1)
    rows = given.select("config_id", "min_market_cap", "max_market_cap", "volume_multiplier", lookback.cast("int").alias("lookback"),
                        *[F.col(c).cast("int").alias(name) for name, c in PERIODS.items()])
    screen = F.struct("volume_multiplier", "config_id", "min_market_cap", "max_market_cap", "lookback")
    groups = rows.groupBy(*PERIODS).agg(F.array_sort(F.collect_list(screen)).alias("screens"), F.max("lookback").alias("lookback"))
    periods = rows.select(F.explode(F.array(*PERIODS)).alias("n")).distinct().where("n > 0")
    return (
        periods.agg(F.array_sort(F.collect_list("n")).alias("n")),
        groups.agg(F.collect_list(F.struct(*PERIODS, "lookback", "screens")).alias("g")),
        rows.agg(F.max("lookback").alias("n")),
    )


def _running_sums(weeks: DataFrame) -> DataFrame:
    """(symbol, rows, close_power, volume_power): a symbol's weeks in order with the sums of all weeks before each."""
    before = f"OVER ({SYMBOL_WEEKS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = []
    for c in ("close", "volume"):
        sums.append(F.expr(f"coalesce(sum({c}_exact) {before}, CAST(0 AS {EXACT}))").alias(f"{c}_sum"))
        sums.append(F.expr(f"coalesce(sum({endless_of(c)}) {before}, 0)").alias(f"{c}_endless"))
    placed = scaled(judging.placed_weeks(weeks)).select("*", *sums)
    row = F.struct("bars_before", "week_end", "age", "close", "volume", "close_sum", "close_endless", "volume_sum", "volume_endless")
    return placed.groupBy("symbol").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.max("close_power").alias("close_power"), F.max("volume_power").alias("volume_power"))


def _mean(c: str, n: Column) -> Column:
    """Mean of the ``n`` weeks before the week ``w``, of fewer if there are no more; exact until it is a double."""
    week, count = F.col("w"), F.least(n, F.col("w.bars_before"))
    then = F.get(F.col("rows"), week["bars_before"] - count)
    exact = (week[f"{c}_sum"] - then[f"{c}_sum"]) / count.cast("long")
    endless = week[f"{c}_endless"] - then[f"{c}_endless"]
    shifted = F.concat(exact.cast("string"), F.lit("E"), F.col(f"{c}_power").cast("string")).cast("double")
    value = F.when(F.col(f"{c}_power") == 0, exact.cast("double")).otherwise(shifted)
    kind = F.when(endless < DOWNWARD, "infinity").when(endless % DOWNWARD == 0, "-infinity").otherwise("nan")
    return F.when(count <= 0, F.lit(None)).when(endless > 0, kind.cast("double")).otherwise(value)


def _means(c: str) -> Column:
    return F.transform("periods", lambda n: _mean(c, n))


def _known(c: str, n: Column, periods: Column, least: float | None) -> Column:
    """The mean of period ``n`` among those worked out for the week; null below its least number of weeks."""
    mean = F.get(F.col(f"{c}_means"), (F.array_position(periods, n) - 1).cast("int"))
    needed = n if least is None else F.greatest(F.floor(n * least), F.lit(1))
    return F.when((n > 0) & (F.least(n, F.col("w.bars_before")) >= needed), mean)


def _reached(screens: Column, volume: Column, average: Column) -> Column:
    """How many of the screens, which are sorted by multiplier, the volume reaches."""
    between = F.struct(F.lit(0).alias("low"), F.size(screens).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        holds = (s["low"] < s["high"]) & (volume >= F.get(screens, middle)["volume_multiplier"] * average)
        low = F.when(holds, middle + 1).otherwise(s["low"])
        return F.struct(low.alias("low"), F.when((s["low"] < s["high"]) & ~holds, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(screens) + 1)).cast("int"))
    return F.when(F.coalesce(average != 0, F.lit(False)), F.aggregate(steps, between, halved)["low"]).otherwise(F.lit(0))


def screen_indexed(weekly: DataFrame, info: DataFrame, settings: DataFrame, dialect: str = "lookback", as_of=None, symbols: DataFrame | None = None) -> DataFrame:
    """Records of all screens of a settings table (``read_settings``), as ``screen_many`` gives them.

    The weeks are windowed once, whatever the number of screens. A symbol's weeks are gathered in an array: one row a
    week, so no group is large. Two screens of one id fail the job, as do, for ``live``, invalid settings. A table without
    screens gives no records.
    """
    rules = dialect_of(dialect)
    if symbols is not None:
        weekly = listed(weekly, symbols)
    all_periods, all_groups, longest = _index(settings, rules)
    weeks = _running_sums(judging.finished_weeks(weekly, as_of)).withColumns({"periods": all_periods.scalar(), "lookback": longest.scalar()})
    judged = F.filter("rows", lambda r: r["age"] <= F.col("lookback"))
    weeks = weeks.withColumn("w", F.explode(judged))
    means = [_means(c).alias(f"{c}_means") for c in ("close", "volume")]
    weeks = weeks.select("symbol", "periods", "w", *means)
    weeks = weeks.withColumn("week_end", F.col("w.week_end")).where(judging.recent_enough(rules, as_of))

    before, close, volume = F.col("w.bars_before"), F.col("w.close"), F.col("w.volume")
    average = lambda g, name: _known("close", g[name], F.col("periods"), MIN_PERIOD_FRACTION)
    state = lambda g, name: P.ma_state(g[name], average(g, name), close, before)
    mean_volume = lambda g: _known("volume", g["volume"], F.col("periods"), MIN_PERIOD_FRACTION)

    def holds(g: Column) -> Column:
        old = P.old_enough(g["short"], g["intermediate"], g["volume"], extra_weeks=rules.extra_weeks, gate_intermediate=rules.gate_intermediate, before=before)
        recent = _known("close", g["recent"], F.col("periods"), None)
        rising = P.price_above_recent(g["recent"], rules.zero_window_passes, close, recent, before)
        return (F.col("w.age") <= g["lookback"]) & old & rising & P.all_ma_hold([state(g, name) for name in AVERAGES])

    def hit(g: Column) -> Column:
        reached = F.slice(g["screens"], F.lit(1), _reached(g["screens"], volume, mean_volume(g)))
        fields = [mean_volume(g).alias("avg_volume"), reached.alias("screens")]
        if rules.rich:
            names = F.array(*[F.lit(name) for name in AVERAGES])
            fields += [F.map_from_arrays(names, F.array(*values)).alias(label) for label, values in (
                ("ma_values", [F.when(state(g, k) != "omitted", average(g, k)) for k in AVERAGES]),
                ("ma_passes", [state(g, k) for k in AVERAGES]), ("ma_periods", [g[k] for k in AVERAGES]))]
        return F.struct(*fields)

    weeks = weeks.withColumn("groups", all_groups.scalar())
    hits = weeks.select("symbol", "w", F.explode(F.transform(F.filter("groups", holds), hit)).alias("hit"))
    hits = hits.select("symbol", "w", "hit", F.explode("hit.screens").alias("s")).where(F.col("w.age") <= F.col("s.lookback"))
    hits = attach_info(hits, info, "inner" if rules.info_required else "left")
    hits = hits.where(P.market_cap_between(F.col("s.min_market_cap"), F.col("s.max_market_cap")))
    rich = ["ma_values", "ma_passes", "ma_periods"] if rules.rich else []
    row = F.struct("w.week_end", "w.close", "w.volume", "hit.avg_volume", *[F.col(f"hit.{c}") for c in rich])
    newest = hits.groupBy("symbol", F.col("s.config_id").alias("config_id")).agg(F.min_by(row, "w.age").alias("r"), F.first("market_cap").alias("market_cap"))
    found = newest.select(
        "config_id", F.col("symbol").alias("ticker"), F.col("r.week_end").cast("string").alias("date"), F.col("r.close").alias("close_price"),
        "market_cap", F.col("r.avg_volume").alias("avg_volume"), (F.col("r.volume") / F.col("r.avg_volume")).alias("volume_ratio"),
        *(["r.volume", *[f"r.{c}" for c in rich]] if rich else []),
    )
    return repeated(found, symbols, "ticker") if rules.keeps_repeats and symbols is not None else found
