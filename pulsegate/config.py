"""Validated parameter records.  They hold parameters only, never data."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

ALLOW, RESTRICT, ISOLATE = 0, 1, 2
STATE_NAMES = ("ALLOW", "RESTRICT", "ISOLATE")

FRICTION_BUDGETS = (0.001, 0.005, 0.01, 0.02, 0.05)
TUNING_SPLIT = "controller_tune"


def _positive(name: str, value: float) -> None:
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and positive")


# The defaults are part of the parameter contract.
@dataclass(frozen=True)
class TraceRule:
    """How a timeline is cut into blocks, leases and epochs."""

    timestamp_scale: float = 100_000.0
    gap_seconds: float | None = 300.0
    max_block_seconds: float | None = 900.0
    lease_gap_seconds: float = 30.0
    epoch_seconds: float = 1.0

    def __post_init__(self) -> None:
        if self.gap_seconds is None and self.max_block_seconds is None:
            raise ValueError("at least one block boundary rule is required")
        for name, value in asdict(self).items():
            if value is not None:
                _positive(name, value)

    @property
    def lease_epoch_bound(self) -> int | None:
        """Most epochs a lease can hold: a lease never leaves its block."""
        if self.max_block_seconds is None:
            return None
        return math.ceil(self.max_block_seconds / self.epoch_seconds) + 1


@dataclass(frozen=True)
class SplitRule:
    """Named chronological splits; a block belongs to the split its end falls in."""

    names: tuple[str, ...] = ("train", "calibration", TUNING_SPLIT, "test")
    cut_times_s: tuple[float, ...] = (1666742400.0, 1666785600.0, 1666828800.0)

    def __post_init__(self) -> None:
        if len(self.names) < 2 or len(set(self.names)) != len(self.names) or not all(self.names):
            raise ValueError("split names must be unique, non-empty and at least two")
        if len(self.cut_times_s) != len(self.names) - 1:
            raise ValueError("need one cut fewer than split names")
        if any(b <= a for a, b in zip(self.cut_times_s, self.cut_times_s[1:])):
            raise ValueError("cut times must be strictly increasing")

    @property
    def reference(self) -> tuple[str, ...]:
        return self.names[:-1]

    @property
    def evaluation(self) -> str:
        return self.names[-1]


@dataclass(frozen=True)
class ControllerRule:
    """Thresholds, persistence, holds and smoothing of one controller."""

    restrict_enter: float
    restrict_exit: float
    isolate_enter: float
    isolate_exit: float
    entry_reports: int = 1
    recovery_reports: int = 1
    entry_duration_s: float = 0.0
    recovery_duration_s: float = 0.0
    min_restrict_hold_s: float = 0.0
    min_isolate_hold_s: float = 0.0
    ewma_tau_s: float | None = None
    initial_state: int = ALLOW
    staged: bool = True

    def __post_init__(self) -> None:
        levels = (self.restrict_exit, self.restrict_enter, self.isolate_exit, self.isolate_enter)
        if not all(map(math.isfinite, levels)):
            raise ValueError("all thresholds must be finite")
        pairs = {
            "restrict_exit <= restrict_enter": self.restrict_exit <= self.restrict_enter,
            "isolate_exit <= isolate_enter": self.isolate_exit <= self.isolate_enter,
            "restrict_enter <= isolate_enter": self.restrict_enter <= self.isolate_enter,
            "restrict_exit <= isolate_exit": self.restrict_exit <= self.isolate_exit,
        }
        broken = [rule for rule, holds in pairs.items() if not holds]
        if broken:
            raise ValueError(f"controller thresholds must satisfy {broken}")
        for name in ("entry_reports", "recovery_reports"):
            value = getattr(self, name)
            if isinstance(value, bool) or value < 1 or int(value) != value:
                raise ValueError(f"{name} must be a positive integer")
        for name in ("entry_duration_s", "recovery_duration_s", "min_restrict_hold_s", "min_isolate_hold_s"):
            value = getattr(self, name)
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{name} must be finite and non-negative")
        if self.ewma_tau_s is not None:
            _positive("ewma_tau_s", self.ewma_tau_s)
        if self.initial_state not in (ALLOW, RESTRICT, ISOLATE):
            raise ValueError(f"invalid initial_state {self.initial_state!r}")

    @property
    def memoryless(self) -> bool:
        """True when a decision depends on the current finite score alone."""
        return (
            not self.staged
            and self.ewma_tau_s is None
            and self.entry_reports == self.recovery_reports == 1
            and not (
                self.entry_duration_s
                or self.recovery_duration_s
                or self.min_restrict_hold_s
                or self.min_isolate_hold_s
            )
        )


def _both(restrict_threshold: float, isolate_threshold: float, **rest: Any) -> ControllerRule:
    return ControllerRule(restrict_threshold, restrict_threshold, isolate_threshold, isolate_threshold, **rest)


def _stateless(restrict_threshold: float, isolate_threshold: float) -> ControllerRule:
    return _both(restrict_threshold, isolate_threshold, staged=False)


def _ewma(restrict_threshold: float, isolate_threshold: float, *, tau_s: float) -> ControllerRule:
    return _both(restrict_threshold, isolate_threshold, staged=False, ewma_tau_s=tau_s)


def _n_report(
    restrict_threshold: float,
    isolate_threshold: float,
    *,
    entry_reports: int,
    recovery_reports: int | None = None,
    min_restrict_hold_s: float = 0.0,
    min_isolate_hold_s: float = 0.0,
) -> ControllerRule:
    return _both(
        restrict_threshold,
        isolate_threshold,
        entry_reports=entry_reports,
        recovery_reports=entry_reports if recovery_reports is None else recovery_reports,
        min_restrict_hold_s=min_restrict_hold_s,
        min_isolate_hold_s=min_isolate_hold_s,
    )


def _symmetric(restrict_center: float, isolate_center: float, *, half_width: float) -> ControllerRule:
    if not math.isfinite(half_width) or half_width < 0:
        raise ValueError("half_width must be finite and non-negative")
    return ControllerRule(
        restrict_enter=restrict_center + half_width,
        restrict_exit=restrict_center - half_width,
        isolate_enter=isolate_center + half_width,
        isolate_exit=isolate_center - half_width,
    )


CONTROLLERS = {
    "stateless": _stateless,
    "n_report": _n_report,
    "ewma": _ewma,
    "symmetric_hysteresis": _symmetric,
    "asymmetric_sequential": ControllerRule,
}


@dataclass(frozen=True)
class CandidateSpec:
    """A named controller: ``controller`` picks the kind, ``parameters`` its arguments."""

    candidate: str
    family: str
    controller: str
    parameters: Mapping[str, Any] = field(default_factory=dict)

    def rule(self) -> ControllerRule:
        try:
            build = CONTROLLERS[self.controller]
        except KeyError:
            raise ValueError(f"unknown controller kind: {self.controller}") from None
        return build(**self.parameters)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class SpecLock:
    """Canonical JSON of the specs and its SHA-256; held-out partitions are refused."""

    canonical_json: str
    sha256: str
    selection_partition: str

    @classmethod
    def of(cls, specs: Sequence[CandidateSpec], selection_partition: str = TUNING_SPLIT) -> SpecLock:
        if any(word in selection_partition.casefold() for word in ("test", "held", "confirm")):
            raise ValueError("candidates cannot be locked on a held-out partition")
        names = [s.candidate for s in specs]
        if not names or len(set(names)) != len(names):
            raise ValueError("candidate names must be unique and non-empty")
        for spec in specs:
            spec.rule()
        rows = sorted((s.to_dict() for s in specs), key=lambda r: r["candidate"])
        text = json.dumps(rows, sort_keys=True, separators=(",", ":"), allow_nan=False)
        return cls(text, hashlib.sha256(text.encode()).hexdigest(), selection_partition)

    def __post_init__(self) -> None:
        if hashlib.sha256(self.canonical_json.encode()).hexdigest() != self.sha256:
            raise ValueError("candidate lock does not match its digest")

    @property
    def specs(self) -> tuple[CandidateSpec, ...]:
        return tuple(CandidateSpec(**row) for row in json.loads(self.canonical_json))


# The defaults are part of the parameter contract.
@dataclass(frozen=True)
class SelectionTolerances:
    """Margins of the cascade selection rule."""

    budget_undershoot_relative: float = 0.05
    security_noninferiority_abs: float = 0.02
    isolation_noninferiority_abs: float = 0.05
    coverage_noninferiority_abs: float = 0.05
    delay_noninferiority_s: float = 1.0
    minimum_transition_reduction: float = 0.25
    numeric_tolerance: float = 1e-12

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            bounded = name not in ("delay_noninferiority_s", "numeric_tolerance")
            if not math.isfinite(value) or value < 0 or (bounded and value >= 1):
                raise ValueError(f"{name} is out of range")


# The defaults are part of the parameter contract.
@dataclass(frozen=True)
class GroupingRule:
    """Label-blind thresholds of the block grouping candidates."""

    fixed_window_seconds: tuple[float, ...] = (3_600, 10_800, 21_600)
    gap_threshold_seconds: tuple[float, ...] = (300, 1_800, 3_600)
    mobility_tv_thresholds: tuple[float, ...] = (0.25, 0.50)
    rnti_jaccard_thresholds: tuple[float, ...] = (0.05, 0.25)
    campaign_gap_seconds: float = 1_800.0
    campaign_mobility_tv: float = 0.25
    campaign_min_rnti_jaccard: float = 0.05

    def __post_init__(self) -> None:
        for value in (*self.fixed_window_seconds, *self.gap_threshold_seconds, self.campaign_gap_seconds):
            _positive("window or gap", value)
        shares = (*self.mobility_tv_thresholds, *self.rnti_jaccard_thresholds)
        for value in (*shares, self.campaign_mobility_tv, self.campaign_min_rnti_jaccard):
            if not 0 <= value <= 1:
                raise ValueError("share thresholds must lie in [0, 1]")
