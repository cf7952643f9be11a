"""Parameters shared by operators, validated when they are built."""

from __future__ import annotations

from dataclasses import dataclass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class DedupParams:
    """Repeat suppression: seconds for the two intervals, emissions per rate period."""

    window: float = 60
    baseline: float = 300
    max_per_period: int = 20
    period: float = 60

    def __post_init__(self) -> None:
        _require(self.window > 0 and self.baseline > 0, "window and baseline must be positive")
        _require(self.max_per_period >= 1, "max_per_period must be at least 1")
        _require(self.period > 0, "period must be positive")

    @property
    def cooldown(self) -> float:
        """Least time between two emissions of one fingerprint."""
        return min(self.window, self.baseline)


@dataclass(frozen=True)
class TrendParams:
    """Smoothing factor, window length in samples and alert cooldown in seconds."""

    alpha: float = 0.1
    window: int = 20
    cooldown: float = 600

    def __post_init__(self) -> None:
        _require(0 < self.alpha < 1, "alpha must be between 0 and 1 exclusive")
        _require(self.window >= 8 and self.window % 2 == 0, "window must be even and at least 8")
        _require(self.cooldown >= 0, "cooldown must not be negative")


@dataclass(frozen=True)
class LevelParams:
    """Two alert levels in percent."""

    warn: float = 80
    crit: float = 95

    def __post_init__(self) -> None:
        _require(0 <= self.warn < self.crit <= 100, "need 0 <= warn < crit <= 100")


@dataclass(frozen=True)
class RetentionParams:
    """Days to keep ordinary events, and service failures or applied fixes."""

    days: int = 30
    critical_days: int = 365

    def __post_init__(self) -> None:
        _require(self.days > 0 and self.critical_days > 0, "retention must be positive")
