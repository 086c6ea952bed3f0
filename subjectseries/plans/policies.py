"""Measurement and episode policies with their argument checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from subjectseries.functions.predicates import zone
from subjectseries.functions.scalars import DEFAULT_TIMEZONE, minutes_to_us


class PolicyError(ValueError):
    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("; ".join(problems))


def _horizon_problems(horizons: tuple[int, ...]) -> list[str]:
    if not horizons:
        return ["no horizon given"]
    problems = []
    if min(horizons) <= 0:
        problems.append("horizons must be positive")
    if list(horizons) != sorted(set(horizons)):
        problems.append("horizons must be distinct and ascending")
    return problems


@dataclass(frozen=True)
class DiagnosticsPolicy:
    gap_warning_minutes: float = 15.0
    gap_major_minutes: float = 60.0
    cadence_minutes: float = 5.0
    target_tolerance_minutes: float = 2.5
    minimum_history_minutes: float = 120.0
    horizons_minutes: tuple[int, ...] = (30, 60, 120)
    timezone: str = DEFAULT_TIMEZONE

    def __post_init__(self) -> None:
        problems = _horizon_problems(self.horizons_minutes)
        if self.cadence_minutes <= 0:
            problems.append("cadence must be positive")
        if self.gap_warning_minutes <= 0:
            problems.append("warning gap must be positive")
        if self.gap_major_minutes < self.gap_warning_minutes:
            problems.append("major gap is below the warning gap")
        if self.target_tolerance_minutes <= 0:
            problems.append("target tolerance must be positive")
        if self.minimum_history_minutes < 0:
            problems.append("minimum history is negative")
        if self.horizons_minutes and self.target_tolerance_minutes >= min(self.horizons_minutes):
            problems.append("target tolerance reaches the smallest horizon")
        if problems:
            raise PolicyError(problems)
        zone(self.timezone)

    def identity(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class EpisodePolicy:
    history_minutes: int = 120
    cadence_minutes: int = 5
    max_gap_minutes: float = 15.0
    start_tolerance_minutes: float = 2.5
    target_tolerance_minutes: float = 2.5
    horizons_minutes: tuple[int, ...] = (30, 60, 120)
    include_events: bool = True

    def __post_init__(self) -> None:
        problems = _horizon_problems(self.horizons_minutes)
        if self.history_minutes <= 0 or self.cadence_minutes <= 0:
            problems.append("history and cadence must be positive")
        elif self.history_minutes % self.cadence_minutes:
            problems.append("history is not a multiple of the cadence")
        if self.max_gap_minutes <= 0:
            problems.append("largest gap must be positive")
        if self.start_tolerance_minutes < 0:
            problems.append("history start tolerance is negative")
        if self.target_tolerance_minutes <= 0:
            problems.append("target tolerance must be positive")
        if problems:
            raise PolicyError(problems)

    @property
    def positions(self) -> int:
        return self.history_minutes // self.cadence_minutes + 1

    @property
    def history_us(self) -> int:
        return minutes_to_us(self.history_minutes)

    @property
    def cadence_us(self) -> int:
        return minutes_to_us(self.cadence_minutes)

    @property
    def start_tolerance_us(self) -> int:
        return minutes_to_us(self.start_tolerance_minutes)

    @property
    def target_tolerance_us(self) -> int:
        return minutes_to_us(self.target_tolerance_minutes)

    @property
    def max_horizon_minutes(self) -> int:
        return max(self.horizons_minutes)

    def identity(self) -> dict:
        return asdict(self)
