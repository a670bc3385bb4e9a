"""The three generations of the screen, told apart by flags of one plan."""

from __future__ import annotations

from dataclasses import dataclass

from ..config import ScreenConfig
from ..constants import RECENCY_DAYS


@dataclass(frozen=True)
class Dialect:
    name: str
    validates: bool = False  # refuses odd settings
    info_required: bool = False  # a symbol without company info is out
    max_age_days: int | None = None  # last week must be this recent
    extra_weeks: int = 0  # history needed beyond short and volume periods
    gate_intermediate: bool = False  # intermediate period must be filled too
    zero_window_passes: bool = False  # price test with a window of 0 weeks
    looks_back: bool = False  # judges several weeks, keeps the newest match
    cap_first: bool = True  # order of the skip reasons
    keeps_repeats: bool = False  # a symbol listed twice is reported twice
    ranked: bool = True  # by volume ratio
    rich: bool = False  # reports moving averages too

    def lookback(self, config: ScreenConfig) -> int:
        return config.lookback_weeks if self.looks_back else 1


DIALECTS = {
    d.name: d
    for d in (
        Dialect(
            "live",
            validates=True,
            max_age_days=RECENCY_DAYS,
            gate_intermediate=True,
            keeps_repeats=True,
            ranked=False,
            rich=True,
        ),
        Dialect("snapshot", info_required=True, zero_window_passes=True),
        Dialect("lookback", extra_weeks=1, looks_back=True, cap_first=False),
    )
}


def dialect_of(name: str) -> Dialect:
    if name not in DIALECTS:
        raise ValueError(f"unknown dialect {name!r}, expected one of {sorted(DIALECTS)}")
    return DIALECTS[name]
