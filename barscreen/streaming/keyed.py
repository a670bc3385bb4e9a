"""Screens kept up to date by state: a batch costs one look-up for a group of symbols, whatever the length of their histories.

For each symbol, in its group's value, Spark's state store holds the closes and volumes of the last weeks, as many as the longest period
reaches. Running sums over these and a batch's new weeks are exact: whole numbers of the smallest unit in which all of them
are written, or, where these pass a double's digits, decimals of the values' shortest texts. The mean of the n weeks before
week t is the difference of the sums at t and t - n over n. So a price that never moves is its own mean.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ScreenConfig
from ..constants import MIN_PERIOD_FRACTION
from ..operators import judging
from ..operators.quality import join_info, one_info_per_symbol
from ..operators.records import rank_results, to_rich, to_slim
from ..plans.dialects import dialect_of
from ..functions.predicates import market_cap_between

#: Sums keep all digits of doubles of any size.
EXACT = Context(prec=800)
#: Digits of a mean before it is rounded to a double.
MEAN = Context(prec=40)
#: Whole numbers below this are exact doubles, and so is their quotient's rounding; decimals of 15 digits name one double.
WHOLE, DIGITS = float(1 << 53), 1e15


#: Groups that symbols are dealt to by hash. A group's state is one value: the price of a look-up is by group, not by symbol.
GROUPS = 1024


class _Means(StatefulProcessor):
    """Features of each week of the symbols of a group; ``periods`` are (column, name, weeks, least values).

    The state is one value a group: for each symbol its last week and the closes and volumes of the last weeks that a
    period can reach. A batch reads and writes it once, however many weeks it brings.
    """

    def __init__(self, periods: list[tuple[str, str, int, int]]):
        self.periods = periods
        self.reach = max((n for _, _, n, _ in periods), default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        # symbols: [symbol, weeks so far, last week] of each as JSON; their closes and volumes one after another
        self.held = handle.getValueState("held", "symbols string, close binary, volume binary")

    def _tails(self) -> dict:
        held = self.held.get()
        if held is None:
            return {}
        found, closes, volumes, end = {}, np.frombuffer(held[1]), np.frombuffer(held[2]), 0
        for symbol, count, last in json.loads(held[0]):
            start, end = end, end + min(count, self.reach)
            found[symbol] = (count, last, {"close": closes[start:end], "volume": volumes[start:end]})
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        code, symbols = pd.factorize(new["symbol"], use_na_sentinel=False)
        week = new["week"].to_numpy()
        order = np.lexsort((week, code))  # a symbol has one row a week; of a repeated week the first counts
        order = order[np.r_[True, (np.diff(code[order]) != 0) | (np.diff(week[order]) != 0)]]
        code, week = code[order], week[order]
        values = {c: new[c].to_numpy(float)[order] for c in ("close", "volume")}
        tails, made = self._tails(), []
        edges = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)].tolist()
        for a, b in zip(edges, edges[1:]):
            symbol = symbols[code[a]]
            symbol = symbol if isinstance(symbol, str) else None
            count, last, tail = tails.get(symbol, (0, None, {"close": np.zeros(0), "volume": np.zeros(0)}))
            if last is not None:
                a += int(np.searchsorted(week[a:b], last, "right"))
            if a < b:
                found, tail = self._features(count, tail, {c: x[a:b] for c, x in values.items()})
                made.append((symbol, week[a:b], found))
                tails[symbol] = (count + b - a, int(week[b - 1]), tail)
        if not made:
            return
        said = json.dumps([[symbol, count, last] for symbol, (count, last, _) in tails.items()])
        self.held.update((said, *(b"".join(t[c].tobytes() for _, _, t in tails.values()) for c in ("close", "volume"))))
        many = np.array([len(w) for _, w, _ in made])
        joined = {c: np.concatenate([f[c] for _, _, f in made]) for c in made[0][2]}
        out = {"symbol": np.repeat(np.array([s for s, _, _ in made], object), many), "week": np.concatenate([w for _, w, _ in made])}
        out.update({c: joined[c] for c in ("close", "volume", "bars_before", "newest")})
        out.update({name: _column(joined[name], joined[f"{name} known"]) for _, name, _, _ in self.periods})
        yield pd.DataFrame(out)

    def _features(self, before: int, tail: dict, new: dict) -> tuple[dict, dict]:
        """Columns for a symbol's new weeks, in order, and the tail that they leave; ``before`` weeks came earlier."""
        place = before + np.arange(len(new["close"]), dtype=np.int32)
        made, after = {**new, "bars_before": place, "newest": place == place[-1]}, {}
        for column in ("close", "volume"):
            values = np.r_[tail[column], new[column]]
            at = np.arange(len(values) - len(place), len(values))
            periods = [(name, n, least) for c, name, n, least in self.periods if c == column]
            mean = _means_of(values, min(max((n for _, n, _ in periods), default=0), len(values)))
            for name, n, least in periods:
                count = np.minimum(n, place)
                known = (count >= max(least, 1)) & (n > 0)
                made[name], made[f"{name} known"] = mean(at, np.where(known, count, 1)), known
            after[column] = values[max(0, len(values) - self.reach) :]
        return made, after

    def close(self) -> None:
        pass


def _column(means: np.ndarray, known: np.ndarray):
    """Means, null where they are not known; those that are no number stay."""
    if np.isnan(means[known]).any():
        return pd.arrays.FloatingArray(means, ~known)
    return np.where(known, means, np.nan)


def _means_of(values: np.ndarray, longest: int):
    """A function that gives, for places and counts, the means of so many ``values`` before each place, of up to ``longest``."""
    finite = np.isfinite(values)
    plain = np.where(finite, values, 0.0)
    before = lambda x: np.r_[np.zeros(1, x.dtype), np.cumsum(x)]
    up, down, none = (before((values == np.inf).astype(np.int64)), before((values == -np.inf).astype(np.int64)), before(np.isnan(values).astype(np.int64)))
    scale = next((s for s in (1.0, 1e2, 1e4, 1e6) if _whole(plain, s)), None)
    if scale is not None and np.abs(np.rint(plain * scale)).max(initial=0) * longest < WHOLE and longest * scale < WHOLE:
        sums = before(np.rint(plain * scale).astype(np.int64))
        exact = lambda at, start: (sums[at] - sums[start]) / ((at - start) * scale)
    else:
        totals = [Decimal(0)]
        for v in plain.tolist():
            totals.append(EXACT.add(totals[-1], Decimal(repr(v))))

        def exact(at, start):
            pairs = zip(at.tolist(), start.tolist())
            return np.array([float(MEAN.divide(EXACT.subtract(totals[a], totals[b]), Decimal(max(a - b, 1)))) for a, b in pairs], float)

    def mean(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        start = np.maximum(at - count, 0)
        with np.errstate(invalid="ignore"):
            found = exact(at, start)
        rising, falling, nothing = (x[at] > x[start] for x in (up, down, none))
        found = np.where(rising, np.inf, np.where(falling, -np.inf, found))
        return np.where(nothing | (rising & falling), np.nan, found)

    return mean


def _whole(values: np.ndarray, scale: float) -> bool:
    """Whether the shortest texts of ``values`` are whole numbers of 1 / ``scale``, of 15 digits at most."""
    scaled = np.rint(values * scale)
    return bool((np.abs(scaled) < DIGITS).all() and (scaled / scale == values).all())


def _periods(config: ScreenConfig) -> list[tuple[str, str, int, int]]:
    least = lambda n: max(int(n * MIN_PERIOD_FRACTION), 1)
    v, p = config.avg_volume_weeks, config.price_avg_weeks
    averages = [("close", f"ma_{name}", n, least(n)) for name, n in config.ma_periods.items()]
    return [("volume", "avg_volume", v, least(v)), ("close", "recent_mean", p, p), *averages]


def stream_features(weekly_stream: DataFrame, config: ScreenConfig) -> DataFrame:
    """Each new week (symbol, week_end, close, volume of ``weekly_stream``) with its trailing means and ``bars_before``.

    Weeks that don't count (no close, no volume) are left out. Weeks of a symbol must come in order; an older one than
    the last is dropped, so redelivered weeks change nothing. ``newest`` marks a symbol's last week in a batch.
    The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    periods = _periods(config)
    kinds = ", ".join(f"{name} double" for _, name, _, _ in periods)
    weeks = weekly_stream.where(judging.usable()).select(
        "symbol", F.unix_date("week_end").alias("week"), F.col("close").cast("double"), F.col("volume").cast("double"))
    group = F.pmod(F.xxhash64("symbol"), F.lit(GROUPS)).cast("int")
    means = weeks.withColumn("group", group).groupBy("group").transformWithStateInPandas(
        _Means(periods),
        f"symbol string, week int, close double, volume double, bars_before int, newest boolean, {kinds}",
        "Append",
        "None",
    )
    names = [F.date_from_unix_date("week").alias("week_end") if c == "week" else F.col(c) for c in means.columns]
    return means.select(*names)


def stream_judged(weekly_stream: DataFrame, config: ScreenConfig, dialect: str = "lookback") -> DataFrame:
    """The weeks of a stream that meet the screen's conditions, and each batch's last week of a symbol: rows to append to a table."""
    rules = dialect_of(dialect)
    if rules.validates:
        config.validate()
    # how recent a week is, and its cap, count when results are read
    features = judging.with_conditions(stream_features(weekly_stream, config), config, rules, None, recency=False)
    return features.withColumn("matched", judging.all_conditions()).where("matched or newest").drop(*judging.CONDITIONS)


def standing_results(judged: DataFrame, info: DataFrame, config: ScreenConfig, dialect: str = "lookback", as_of=None) -> DataFrame:
    """What the screen says now, from the rows of ``stream_judged``: records as ``screen`` gives them.

    For each symbol its newest matching week of the last ``lookback_weeks`` (of the newest week, for dialects that
    don't look back). Rows are combined before they are shuffled; nothing is ordered within a symbol.
    """
    rules = dialect_of(dialect)
    row = F.struct(*[c for c in judged.columns if c not in ("symbol", "newest", "matched")])
    held = judged.groupBy("symbol").agg(
        F.max("bars_before").alias("top"), F.max_by(row, F.when(F.col("matched"), F.col("bars_before"))).alias("match"))
    found = held.where("match is not null").select("symbol", "match.*", (F.col("top") - F.col("match.bars_before") + 1).alias("age"))
    found = found.where((F.col("age") <= rules.lookback(config)) & judging.recent_enough(rules, as_of))
    found = join_info(found, one_info_per_symbol(info), "inner" if rules.info_required else "left")
    found = found.where(market_cap_between(config.min_market_cap, config.max_market_cap))
    records = to_rich(found, config) if rules.rich else to_slim(found)
    return rank_results(records) if rules.ranked else records
