"""Vectorised controller step shared by the batch fold, the search and the stream.

State is a ``(groups, candidates)`` matrix.  Rows of many leases advance together, one
report per lease at a time, so a batch costs as many numpy steps as its longest lease,
not as many as its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from pulsegate.config import ControllerRule

NONE = -1


@dataclass
class RuleMatrix:
    """Controller parameters as one row vector per field."""

    restrict_enter: np.ndarray
    restrict_exit: np.ndarray
    isolate_enter: np.ndarray
    isolate_exit: np.ndarray
    entry_reports: np.ndarray
    recovery_reports: np.ndarray
    entry_duration_s: np.ndarray
    recovery_duration_s: np.ndarray
    min_restrict_hold_s: np.ndarray
    min_isolate_hold_s: np.ndarray
    tau: np.ndarray
    initial_state: np.ndarray
    staged: np.ndarray

    @classmethod
    def of(cls, rules: Sequence[ControllerRule]) -> RuleMatrix:
        def vector(name: str, kind: type = float) -> np.ndarray:
            return np.array([getattr(r, name) for r in rules], dtype=kind)[None, :]

        floats = (
            "restrict_enter restrict_exit isolate_enter isolate_exit entry_duration_s recovery_duration_s "
            "min_restrict_hold_s min_isolate_hold_s"
        ).split()
        return cls(
            **{n: vector(n) for n in floats},
            entry_reports=vector("entry_reports", np.int64),
            recovery_reports=vector("recovery_reports", np.int64),
            tau=np.array([np.nan if r.ewma_tau_s is None else r.ewma_tau_s for r in rules])[None, :],
            initial_state=vector("initial_state", np.int8),
            staged=vector("staged", bool),
        )

    def __len__(self) -> int:
        return self.tau.shape[1]


@dataclass
class FoldState:
    """Per lease and candidate; times are per lease."""

    state: np.ndarray
    since: np.ndarray
    evidence: np.ndarray
    wanted: np.ndarray
    wanted_since: np.ndarray
    wanted_reports: np.ndarray
    last_time: np.ndarray
    evidence_time: np.ndarray

    @classmethod
    def start(cls, rules: RuleMatrix, t: np.ndarray) -> FoldState:
        n, c = len(t), len(rules)
        return cls(
            state=np.repeat(rules.initial_state, n, axis=0),
            since=np.repeat(t[:, None].astype(float), c, axis=1),
            evidence=np.full((n, c), np.nan),
            wanted=np.full((n, c), NONE, dtype=np.int8),
            wanted_since=np.zeros((n, c)),
            wanted_reports=np.zeros((n, c), dtype=np.int64),
            last_time=t.astype(float).copy(),
            evidence_time=np.full(n, np.nan),
        )

    def take(self, rows: slice | np.ndarray) -> FoldState:
        return FoldState(**{k: v[rows] for k, v in self.__dict__.items()})

    def put(self, rows: slice | np.ndarray, other: FoldState) -> None:
        for name, values in self.__dict__.items():
            values[rows] = getattr(other, name)


def advance(rules: RuleMatrix, s: FoldState, t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Feed one report per lease; updates ``s`` in place and returns the evidence."""
    if np.any(t < s.last_time):
        raise ValueError("timestamps must not decrease within a lease")
    s.last_time = t.astype(float)
    finite = np.isfinite(x)
    now, score = t[:, None], np.where(finite, x, np.nan)[:, None]

    fresh = np.broadcast_to(score, s.evidence.shape)
    # Only controllers with a time constant smooth; the exponential is the dearest step.
    smooth = np.flatnonzero(~np.isnan(rules.tau[0]))
    if len(smooth):
        fresh, held, seen = fresh.copy(), s.evidence[:, smooth], ~np.isnan(s.evidence_time)[:, None]
        gain = -np.expm1(-(now - s.evidence_time[:, None]) / rules.tau[:, smooth])
        fresh[:, smooth] = np.where(seen, held + gain * (score - held), score)
    s.evidence = np.where(finite[:, None], fresh, s.evidence)
    s.evidence_time = np.where(finite, t, s.evidence_time)
    shown = np.where(finite[:, None], fresh, np.nan)

    high, middle = shown >= rules.isolate_enter, shown >= rules.restrict_enter
    entered = np.where(high, 2, np.where(middle, 1, 0))
    from_restrict = np.where(high, 2, np.where(shown < rules.restrict_exit, 0, 1))
    from_isolate = np.where(shown < rules.isolate_exit, 1, 2)
    by_state = np.where(s.state == 0, entered, np.where(s.state == 1, from_restrict, from_isolate))
    goal = np.where(rules.staged, by_state, entered).astype(np.int8)

    pending = finite[:, None] & (goal != s.state)
    repeated = pending & (s.wanted == goal)
    s.wanted_reports = np.where(pending, np.where(repeated, s.wanted_reports + 1, 1), 0)
    s.wanted_since = np.where(repeated, s.wanted_since, now)
    s.wanted = np.where(pending, goal, NONE).astype(np.int8)

    up = goal > s.state
    enough = s.wanted_reports >= np.where(up, rules.entry_reports, rules.recovery_reports)
    lasted = now - s.wanted_since >= np.where(up, rules.entry_duration_s, rules.recovery_duration_s)
    hold = np.where(s.state == 2, rules.min_isolate_hold_s, rules.min_restrict_hold_s)
    moved = pending & enough & lasted & (up | (now - s.since >= hold))
    s.state = np.where(moved, goal, s.state).astype(np.int8)
    s.since = np.where(moved, now, s.since)
    s.wanted = np.where(moved, NONE, s.wanted).astype(np.int8)
    s.wanted_reports = np.where(moved, 0, s.wanted_reports)
    return shown


@dataclass
class FoldResult:
    """Decisions of a sorted batch; ``effective`` is the decision of the report before."""

    decision: np.ndarray
    previous: np.ndarray
    effective: np.ndarray
    previous_effective: np.ndarray
    evidence: np.ndarray | None


class SortedFold:
    """Folds sorted batches of one partition; the last lease of a batch may continue."""

    def __init__(self, rules: Sequence[ControllerRule], evidence: bool = True):
        self.rules = RuleMatrix.of(rules)
        self.keep_evidence = evidence
        self._open: tuple[FoldState, np.ndarray, np.ndarray] | None = None

    def resume(self, state: FoldState) -> None:
        """Go on with a stored lease; actions in force before it are not known (ALLOW)."""
        allow = np.zeros((1, len(self.rules)), dtype=np.int8)
        self._open = (state, allow, allow.copy())

    @property
    def open_state(self) -> FoldState:
        """Controller of the last lease of the last batch."""
        if self._open is None:
            raise ValueError("nothing folded yet")
        return self._open[0]

    def run(
        self, first: np.ndarray, t: np.ndarray, x: np.ndarray, held: tuple[np.ndarray, FoldState] | None = None
    ) -> FoldResult:
        """``first`` marks the rows that open a lease; row 0 may continue the open one.

        ``held`` are rows that continue stored leases, and their states; actions in force before them
        are not known (ALLOW).  ``ended`` then has the state of every lease of the batch, in row order.
        """
        n, c = len(t), len(self.rules)
        opens = np.array(first, dtype=bool)
        if held is not None:
            opens[held[0]] = True
        starts = np.flatnonzero(opens)
        continued = n > 0 and not opens[0]
        if continued:
            starts = np.r_[0, starts]
        lengths = np.diff(np.r_[starts, n])
        # Leases by falling length: the active ones are always a prefix.
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]

        state = FoldState.start(self.rules, t[starts])
        decided = np.repeat(self.rules.initial_state, len(starts), axis=0)
        acted = np.zeros((len(starts), c), dtype=np.int8)
        before = np.zeros((len(starts), c), dtype=np.int8)
        if continued:
            if self._open is None:
                raise ValueError("the first row of a partition must open a lease")
            at = np.flatnonzero(starts == 0)
            carried, carried_acted, carried_before = self._open
            state.put(at, carried)
            acted[at], before[at] = carried_acted, carried_before
            decided[at] = carried.state
        if held is not None:
            place = np.zeros(n, dtype=np.int64)
            place[starts] = np.arange(len(starts))
            state.put(place[held[0]], held[1])

        shape = (n, c)
        out = FoldResult(
            *(np.zeros(shape, dtype=np.int8) for _ in range(4)),
            np.full(shape, np.nan) if self.keep_evidence else None,
        )
        for step in range(int(lengths.max()) if n else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            head = slice(0, live)
            rows = starts[head] + step
            part = state.take(head)
            previous = part.state.copy()
            shown = advance(self.rules, part, t[rows], x[rows])
            state.put(head, part)
            out.previous[rows] = previous
            out.decision[rows] = part.state
            out.effective[rows] = acted[head]
            out.previous_effective[rows] = before[head]
            if out.evidence is not None:
                out.evidence[rows] = shown
            before[head] = acted[head]
            acted[head] = part.state
        if n:
            last = np.flatnonzero(starts == starts.max())
            self._open = (state.take(last), acted[last], before[last])
        self.ended = state.take(np.argsort(starts))
        return out
