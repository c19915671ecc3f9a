"""Parameters of the operators, checked when made."""

from __future__ import annotations

from dataclasses import dataclass


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Corruption:
    """Sliding-window selection of chunks with much motion."""

    size: int = 20
    step: int = 1
    threshold: float = 1.0
    min_fraction: float = 0.5
    min_streak: int = 3
    min_mean: float = 1.0
    max_fd: float = 10.0

    def __post_init__(self) -> None:
        _require(self.size > 0 and self.step > 0, "size and step must be positive")
        _require(0 < self.min_fraction <= 1, "min_fraction must be in (0, 1]")
        _require(0 < self.min_streak <= self.size, "min_streak must be between 1 and size")
        _require(0 < self.threshold < self.max_fd, "threshold must be between 0 and max_fd")


@dataclass(frozen=True)
class SafeZone:
    """Selection of chunks without spikes, away from any spike."""

    size: int = 20
    threshold: float = 0.25
    before: int = 5
    after: int = 10

    def __post_init__(self) -> None:
        _require(self.size > 0 and self.before >= 0 and self.after >= 0, "size must be positive and buffers not negative")
        _require(self.threshold > 0, "threshold must be positive")


@dataclass(frozen=True)
class Split:
    """Shares of the subjects; what is left is the test split."""

    train: float = 0.70
    val: float = 0.15
    seed: int = 42

    def __post_init__(self) -> None:
        _require(0 < self.train < 1 and 0 <= self.val and self.train + self.val <= 1, "shares must be in (0, 1) and not exceed 1")


@dataclass(frozen=True)
class QcLimits:
    fd: float = 0.5
    tsnr: float = 10.0


#: Radius in mm that turns rotations into displacements.
RADIUS = 50.0
#: Canonical order of splits, and the names of the two domains.
SPLITS = ("train", "val", "test")
DOMAINS = ("A_corrupted", "B_motion_free")


def splits(wanted: list[str] | None = None) -> list[str]:
    """The wanted splits (validation and test by default) in canonical order, each once."""
    wanted = list(wanted) if wanted else ["val", "test"]
    unknown = set(wanted) - set(SPLITS)
    _require(not unknown, f"unknown splits: {sorted(unknown)}")
    return [s for s in SPLITS if s in wanted]
