"""Market screening over price and volume history, as Spark plans."""

from .config import ScreenConfig, read_settings, required_years, write_settings
from .functions.cleaning import packed_order, utc_instant
from .functions.formatting import (
    chart_url,
    detect_suffix,
    format_market_cap,
    ma_label,
    quote_url,
    with_suffix,
)
from .functions.predicates import (
    all_ma_hold,
    ma_state,
    ma_states,
    market_cap_between,
    old_enough,
    price_above_recent,
    volume_spike,
)
from .functions.trailing import (
    avg_volume,
    bar_age,
    bar_position,
    moving_averages,
    preceding_mean,
    scaled,
    trailing_mean,
    volume_ratio,
)
from .operators.judging import judged_weeks, newest_match, placed_weeks
from .operators.quality import attach_info, coverage_report, drop_empty_bars, missing_symbols, valid_info
from .operators.records import rank_results, sort_results, to_display, to_rich, to_slim
from .operators.weekly import complete_weeks, daily_bars, history_range, recent_only, save_weekly, usable_weeks, weekly_bars
from .plans.diagnostics import explain_screen, screen_summary
from .plans.indexed import screen_indexed
from .plans.many import screen_many
from .plans.observed import observed_screen
from .plans.screens import matching_weeks, screen, screen_bars, screen_matches
from .sources.snapshot import Snapshot, read_snapshot, renew_snapshot, snapshot_metadata, write_snapshot
from .sources.versions import KeyedTable
from .sources.symbols import distinct_symbols, read_symbols, symbols_from_table, write_symbols
from .sources.tables import bars_from_table, bars_from_wide, checked_bars, info_from_table, read_bars, save_bars
from .streaming.jobs import current_results, dedupe_bars, stream_screen, stream_weekly_bars
from .streaming.keyed import standing_results, stream_features, stream_judged
