"""Row-by-row restatements of the stateful definitions, used only to check the library."""

from __future__ import annotations

import math


def walk_controller(rule, rows):
    """``rows`` of (lease, t, score) of one entity in order -> (previous, state, evidence, start)."""
    out, run = [], None
    for lease, t, score in rows:
        start = run is None or run["lease"] != lease
        if start:
            run = {"lease": lease, "state": rule.initial_state, "since": t, "ev": None, "ev_t": None, "want": None, "n": 0, "w_t": t}
        before, shown = run["state"], math.nan
        if score is None or not math.isfinite(score):
            run["want"] = None
        else:
            if rule.ewma_tau_s is None or run["ev"] is None:
                shown = score
            else:
                shown = run["ev"] - math.expm1(-(t - run["ev_t"]) / rule.ewma_tau_s) * (score - run["ev"])
            run["ev"], run["ev_t"] = shown, t
            direct = 2 if shown >= rule.isolate_enter else 1 if shown >= rule.restrict_enter else 0
            goal = direct
            if rule.staged and before == 1:
                goal = 2 if shown >= rule.isolate_enter else 0 if shown < rule.restrict_exit else 1
            elif rule.staged and before == 2:
                goal = 1 if shown < rule.isolate_exit else 2
            if goal == before:
                run["want"] = None
            else:
                if run["want"] == goal:
                    run["n"] += 1
                else:
                    run["want"], run["n"], run["w_t"] = goal, 1, t
                up = goal > before
                need = rule.entry_reports if up else rule.recovery_reports
                last = rule.entry_duration_s if up else rule.recovery_duration_s
                hold = {1: rule.min_restrict_hold_s, 2: rule.min_isolate_hold_s}.get(before, 0.0)
                if run["n"] >= need and t - run["w_t"] >= last and (up or t - run["since"] >= hold):
                    run["state"], run["since"], run["want"] = goal, t, None
        out.append((before, run["state"], shown, start))
    return out


def walk_blocks(times, gap, width):
    ids, block, last = [], -1, None
    for t in times:
        opens = last is None or (gap is not None and t - last > gap)
        if width is not None and last is not None and math.floor(t / width) != math.floor(last / width):
            opens = True
        block += opens
        ids.append(block)
        last = t
    return ids


def walk_epoch_episodes(rows, merge_gap, cap):
    """``rows`` of (t, d, inside, state, previous) of one lease and stream, in order."""
    done, run = [], None

    def close():
        first = run["first"]
        span = run["end"] - run["start"]
        capped = min(first - run["start"] if first is not None else span, cap)
        done.append((run["start"], run["end"], run["n"], first is not None, capped, run["before"], run["pre"]))

    for t, d, inside, state, previous in rows:
        if not inside:
            if run:
                close()
            run = None
            continue
        if run and t - d - run["end"] > merge_gap + 1e-12:
            close()
            run = None
        if run is None:
            run = {"start": t - d, "n": 0, "first": None, "before": 0.0, "pre": previous >= 1}
        run["end"] = t
        run["n"] += 1
        if state >= 1 and run["first"] is None:
            run["first"] = t - d
        if run["first"] is None:
            run["before"] += d
    if run:
        close()
    return done


def walk_report_episodes(rows, cap):
    """``rows`` of (t, d, attack, state) of one lease, in order."""
    done, run = [], None
    for t, d, attack, state in [*rows, (0.0, 0.0, False, 0)]:
        if not attack:
            if run:
                delay = run["first"] - run["start"] if run["first"] is not None else run["d"]
                done.append((run["start"], run["d"], run["n"], run["first"] is not None, min(delay, run["d"], cap)))
            run = None
            continue
        run = run or {"start": t, "d": 0.0, "n": 0, "first": None}
        run["d"] += d
        run["n"] += 1
        if state >= 1 and run["first"] is None:
            run["first"] = t
    return done


def walk_durations(rows, cap):
    """``rows`` of (row, subject, lease, t) in order -> {row: seconds}."""
    out, last, generation = {}, {}, {}
    for row, subject, lease, t in rows:
        if subject in last:
            old_row, old_lease, old_t = last[subject]
            if old_lease == lease:
                out[old_row] = min(t - old_t, cap)
            else:
                generation[subject] = generation.get(subject, 0) + 1
        out[row] = 0.0
        last[subject] = (row, lease, t)
    return out
