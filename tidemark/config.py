"""Rollup settings of a metric, and arithmetic on the bucket grid. Times are int64 nanoseconds since the epoch."""

from __future__ import annotations

import enum
from dataclasses import dataclass

SECOND = 1_000_000_000
DAY = 86_400 * SECOND
LIMIT = (1 << 63) - 1


class Mode(enum.Enum):
    """What a metric may be used for: W overwrites, RW appends."""

    READ = "R"
    WRITE = "W"
    READ_WRITE = "RW"

    @property
    def reads(self) -> bool:
        return self is not Mode.WRITE

    @property
    def writes(self) -> bool:
        return self is not Mode.READ


def interval_begin(t: int, interval: int) -> int:
    """The start of the bucket that holds t; the grid is anchored at the epoch."""
    if t < 0:
        raise ValueError("times before the epoch have no bucket")
    return t - t % interval


def interval_end(t: int, interval: int) -> int:
    """The end of the bucket that holds t, always after t."""
    return interval_begin(t, interval) + interval


def grid_ceil(t: int, interval: int) -> int:
    """The first bucket start at or after t."""
    return interval_end(t - 1, interval) if t > 0 else 0


@dataclass(frozen=True)
class RollupConfig:
    """Widths of the levels: interval_min · interval_factor^k, up to interval_max."""

    interval_min: int = 10 * SECOND
    interval_max: int = 365 * DAY
    interval_factor: int = 10

    def __post_init__(self):
        if self.interval_factor < 2:
            raise ValueError("interval_factor must be at least 2")
        if self.interval_min <= 0:
            raise ValueError("interval_min must be positive")
        if self.interval_min % self.interval_factor:
            raise ValueError("interval_min must be a multiple of interval_factor")
        if self.interval_max < self.interval_min:
            raise ValueError("interval_max must not be below interval_min")
        if max(self.interval_min, self.interval_max) > LIMIT:
            raise OverflowError("intervals are 64-bit nanoseconds")

    @classmethod
    def from_dict(cls, d: dict) -> RollupConfig:
        return cls(**{k: int(d[k]) for k in ("interval_min", "interval_max", "interval_factor") if k in d})

    def to_dict(self) -> dict[str, int]:
        return {"interval_min": self.interval_min, "interval_max": self.interval_max, "interval_factor": self.interval_factor}

    @property
    def levels(self) -> list[int]:
        """All level widths, ascending. The lowest always exists."""
        out, width = [], self.interval_min
        while width <= self.interval_max:
            out.append(width)
            width = self.multiply(width)
            if width > LIMIT:
                break
        return out

    def multiply(self, interval: int) -> int:
        return interval * self.interval_factor

    def divide(self, interval: int) -> int:
        if interval % self.interval_factor:
            raise ValueError(f"{interval} is not a multiple of {self.interval_factor}")
        return interval // self.interval_factor

    def level_for(self, limit: int) -> int | None:
        """The widest level of at most ``limit``; None if even the lowest is wider."""
        fitting = [w for w in self.levels if w <= limit]
        return fitting[-1] if fitting else None
