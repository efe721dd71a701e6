"""Settings as nested dictionaries: defaults, presets, and overlays of one on another."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

Settings = dict[str, Any]

#: Default thresholds. Accepted and unused: dma200_breakout.min_pct_above, rsi.flag_above, universe.*, data.benchmark_index, data.cache_dir.
DEFAULTS: Settings = {
    "data": {"history_days": 400, "cache_ttl_hours": 6, "max_requests_per_second": 2.5, "min_bars": 60},
    "filters": {
        "liquidity": {"enabled": True, "min_price": 20, "min_avg_turnover_cr": 3, "turnover_lookback": 20},
        "volume": {"enabled": True, "surge_multiplier": 1.5, "lookback": 20},
        "dma50_breakout": {"enabled": True, "lookback_days": 5, "min_pct_above": 0.0},
        "dma200_breakout": {"enabled": False, "lookback_days": 10, "min_pct_above": 0.0},
        "rsi": {"enabled": True, "period": 14, "min_rsi": 60, "max_rsi": 100, "flag_above": 70},
        "donchian_breakout": {"enabled": True, "period": 20},
        "trend_filter": {"enabled": True, "require_50_above_200": True, "require_price_above_50": True, "require_price_above_200": True},
        "adx": {"enabled": True, "period": 14, "min_adx": 20},
        "supertrend": {"enabled": True, "period": 10, "multiplier": 3.0, "flip_lookback_days": 3},
        "fundamentals": {
            "enabled": False, "max_market_cap_cr": 5000, "ebitda_margin_min": 15, "ebitda_margin_max": 25, "min_roe_pct": 15,
            "max_debt_to_equity": 2.0, "require_complete_data": False,
        },
        "growth_quality": {
            "enabled": True, "sales_growth_min_pct": 20, "pat_growth_min_pct": 40, "max_annualized_volatility_pct": 35, "min_beta": 0.8,
            "max_beta": 1.2, "max_peg": 1.0, "require_complete_data": False, "theme_filter_enabled": False, "selected_themes": [],
        },
        "breakout_radar": {"bollinger_period": 20, "max_pct_below_pivot": 5.0, "hit_rate_forward_days": 15, "hit_rate_target_return_pct": 10.0},
        "gann_panel": {
            "swing_lookback": 10, "anchor_window_days": 250, "cycle_angles_degrees": [90, 180, 270, 360], "window_tolerance_days": 3,
            "confirmation_lookforward_days": 10, "upcoming_horizon_days": 60, "recent_past_days": 30,
        },
        "false_move_filter": {"enabled": False, "pattern_lookback_days": 3, "rsi_bullish_min": 60, "rsi_bearish_max": 40},
        "btst_check": {"min_close_strength": 0.7, "min_volume_surge": 1.5, "min_weekly_rsi": 55.0, "target_return_pct": 4.5, "stop_loss_pct": 2.0},
    },
    "conviction": {
        "weights": {"trend": 20, "momentum": 20, "volume": 15, "breakout_quality": 20, "relative_strength": 15, "sector_strength": 10},
        "extended_penalty": {"enabled": True, "pct_above_pivot_threshold": 12, "penalty_points": 15},
        "rsi_overbought_penalty": {"enabled": True, "threshold": 82, "penalty_points": 10},
        "tiers": {"very_high_conviction": 75, "high_conviction": 60, "moderate_conviction": 45, "watchlist": 0},
        "target_horizon_days": [1, 15],
    },
    "risk": {"atr_stop_multiplier": 1.5, "atr_target_multiplier": 3.0},
}

_WEIGHTS = {"trend": 15, "momentum": 25, "volume": 20, "breakout_quality": 25, "relative_strength": 10, "sector_strength": 5}

#: Overlays by trading style.
PRESETS: dict[str, Settings] = {
    "custom": {},
    "swing": {
        "filters": {
            "liquidity": {"min_price": 30, "min_avg_turnover_cr": 5},
            "volume": {"surge_multiplier": 1.8},
            "dma50_breakout": {"lookback_days": 5},
            "dma200_breakout": {"enabled": False},
            "trend_filter": {"require_50_above_200": False},
            "rsi": {"min_rsi": 55, "max_rsi": 85, "flag_above": 70},
            "donchian_breakout": {"period": 15},
            "adx": {"min_adx": 18},
            "supertrend": {"period": 7, "multiplier": 2.0, "flip_lookback_days": 2},
        },
        "conviction": {"weights": _WEIGHTS, "extended_penalty": {"pct_above_pivot_threshold": 8}, "rsi_overbought_penalty": {"threshold": 78}},
    },
    "positional": {
        "filters": {
            "liquidity": {"min_price": 30, "min_avg_turnover_cr": 5},
            "volume": {"surge_multiplier": 1.5},
            "dma50_breakout": {"lookback_days": 10},
            "dma200_breakout": {"enabled": True},
            "trend_filter": {"require_50_above_200": True},
            "rsi": {"min_rsi": 60, "max_rsi": 80, "flag_above": 70},
            "donchian_breakout": {"period": 50},
            "adx": {"min_adx": 22},
            "supertrend": {"period": 10, "multiplier": 3.0, "flip_lookback_days": 5},
        },
        "conviction": {"weights": _WEIGHTS, "extended_penalty": {"pct_above_pivot_threshold": 15}, "rsi_overbought_penalty": {"threshold": 82}},
    },
    "breakout125": {
        "filters": {
            "liquidity": {"enabled": True, "min_price": 20, "min_avg_turnover_cr": 3},
            "volume": {"enabled": True, "surge_multiplier": 1.0, "lookback": 125},
            "dma50_breakout": {"enabled": False},
            "dma200_breakout": {"enabled": False},
            "trend_filter": {"enabled": False},
            "rsi": {"enabled": True, "min_rsi": 0, "max_rsi": 70, "flag_above": 70},
            "donchian_breakout": {"enabled": True, "period": 125},
            "adx": {"enabled": False},
            "supertrend": {"enabled": False},
        }
    },
}


def overlay(base: Settings, over: Settings) -> Settings:
    """A deep copy of base in which dictionaries are merged and anything else is replaced."""
    out = deepcopy(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = overlay(out[key], value) if both else deepcopy(value)
    return out


def settings(preset: str = "custom", over: Settings | None = None) -> Settings:
    return overlay(overlay(DEFAULTS, PRESETS[preset]), over or {})


def load_yaml(path: str) -> Settings:
    """Defaults under the settings of a YAML file."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs the yaml package") from e
    with open(path) as f:
        return overlay(DEFAULTS, yaml.safe_load(f) or {})
