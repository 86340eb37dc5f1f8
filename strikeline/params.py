"""Thresholds and weights that operators take as literals."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    """Every threshold of every operator; nothing is global."""

    as_of: dt.datetime = dt.datetime(2002, 1, 2, 21, 0, 0, tzinfo=dt.timezone.utc)
    market_zone: str = "America/New_York"
    min_bid: float | None = None
    min_open_interest: float = 100
    min_volume: float = 10
    max_spread_pct_of_mid: float = 0.25
    max_strike_distance_pct: float = 0.35
    risk_free_rate: float = 0.045
    hv_lookback_days: int = 30
    trading_days_per_year: int = 252
    stale_quote_seconds: int = 10800
    income_weight: float = 0.30
    liquidity_weight: float = 0.30
    risk_weight: float = 0.25
    efficiency_weight: float = 0.15
    max_expiration_weeks: int = 34
    enable_filters: bool = True
    strike_tolerance: float = 0.01
    warn_age_seconds: int = 3 * 3600
    block_age_seconds: int = 24 * 3600

    @property
    def today(self) -> dt.date:
        """The calendar date of as_of in the market's zone."""
        from zoneinfo import ZoneInfo

        return self.as_of.astimezone(ZoneInfo(self.market_zone)).date()

    @property
    def max_expiration(self) -> dt.date:
        return self.today + dt.timedelta(weeks=self.max_expiration_weeks)

    def fingerprint(self) -> str:
        """SHA-256 of all settings as sorted JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()
