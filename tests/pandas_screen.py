"""The screens once more, one symbol at a time in plain pandas, as a check.

Written from the semantics table of the blueprint; shares no code with the library.
"""

import math

import pandas as pd

RULES = {
    # needs info, recency, extra weeks, intermediate gate, empty price window passes
    "live": (False, True, 0, True, False),
    "snapshot": (True, False, 0, False, True),
    "lookback": (False, False, 1, False, False),
}


def to_weeks(days: pd.DataFrame) -> list[tuple]:
    weeks = {}
    for row in days.sort_values("session_date", kind="stable").itertuples():
        label = row.session_date + pd.Timedelta(days=(-row.session_date.weekday()) % 7)
        closes, volumes = weeks.setdefault(label, ([], []))
        if not math.isnan(row.close):
            closes.append(row.close)
        if not math.isnan(row.volume):
            volumes.append(row.volume)
    return [(w, c[-1], sum(v)) for w, (c, v) in sorted(weeks.items()) if c and sum(v) > 0]


def judge(weeks, at, cfg, dialect, cap, as_of):
    _, recency, extra, mid_gate, empty_passes = RULES[dialect]
    label, close, volume = weeks[at]
    closes = pd.Series([c for _, c, _ in weeks])
    volumes = pd.Series([v for _, _, v in weeks])

    def rolled(s, n):
        return s.shift(1).rolling(n, min_periods=int(n * 0.8)).mean().iloc[at] if n > 0 else math.nan

    if recency and (as_of - label).days > 7:
        return None
    if at < cfg.ma_short + extra or at < cfg.avg_volume_weeks + extra:
        return None
    if mid_gate and at < cfg.ma_intermediate:
        return None
    usual = rolled(volumes, cfg.avg_volume_weeks)
    if math.isnan(usual) or usual == 0 or volume < cfg.volume_multiplier * usual:
        return None
    span = cfg.price_avg_weeks
    if span == 0:
        if not empty_passes:
            return None
    elif at < span or close <= closes.iloc[at - span : at].mean():
        return None
    for n in cfg.ma_periods.values():
        if at >= n and not close > rolled(closes, n):
            return None
    low, high = cfg.min_market_cap, cfg.max_market_cap
    if cap is None:
        if low > 0:
            return None
    elif (low > 0 and cap / 1e6 < low) or (high > 0 and cap / 1e6 > high):
        return None
    return str(label.date()), close, volume / usual


def run(bars: pd.DataFrame, caps: dict, cfg, dialect: str, as_of: str) -> dict:
    today, found = pd.Timestamp(as_of), {}
    for symbol, days in bars.groupby("symbol"):
        if RULES[dialect][0] and symbol not in caps:
            continue
        weeks = [w for w in to_weeks(days) if w[0] <= today]
        for age in range(1, (cfg.lookback_weeks if dialect == "lookback" else 1) + 1):
            if age > len(weeks):
                break
            hit = judge(weeks, len(weeks) - age, cfg, dialect, caps.get(symbol), today)
            if hit:
                found[symbol] = hit
                break
    return found
