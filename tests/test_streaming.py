"""The online controller over several triggers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pulsegate import columns as C
from pulsegate.config import CandidateSpec
from pulsegate.schema import TraceError
from pulsegate.streaming import online
from tests.walkers import walk_controller

SPEC = CandidateSpec(
    "p",
    "proposed",
    "asymmetric_sequential",
    dict(restrict_enter=0.5, restrict_exit=0.4, isolate_enter=0.8, isolate_exit=0.6, recovery_reports=2, ewma_tau_s=2.0),
)


def _write(folder, rows):
    for number, part in enumerate(np.array_split(np.arange(len(rows)), 4)):
        pdf = pd.DataFrame([rows[i] for i in part], columns=[C.SUBJECT, C.LEASE, C.DECISION_TIME, C.SCORE])
        pdf.to_parquet(folder / f"part-{number}.parquet")


def test_state_survives_triggers(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 4)), f"L{i // 60}", float(i), float(np.round(rng.random(), 2)) if i % 9 else None) for i in range(160)]
    source = tmp_path / "in"
    source.mkdir()
    _write(source, rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    schema = spark.read.parquet(str(source)).schema
    stream = online.read_event_stream(spark, str(source), schema, files_per_trigger=1)
    got = online.run_to_table(online.online_decisions(stream, SPEC), str(tmp_path / "out")).collect()
    assert len(got) == len(rows)
    for subject in range(4):
        own = [r for r in rows if r[0] == subject]
        want = walk_controller(SPEC.rule(), [(r[1], r[2], r[3]) for r in own])
        mine = sorted((r for r in got if r[C.SUBJECT] == subject), key=lambda r: r[C.DECISION_TIME])
        assert [(r["previous_state"], r["state"], r["lifecycle_start"]) for r in mine] == [(w[0], w[1], w[3]) for w in want]


def test_time_running_backwards_fails_the_query(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _write(source, [(1, "L", 5.0, 0.1), (1, "L", 6.0, 0.1), (1, "L", 3.0, 0.1), (1, "L", 7.0, 0.1)])
    schema = spark.read.parquet(str(source)).schema
    stream = online.read_event_stream(spark, str(source), schema, files_per_trigger=1)
    with pytest.raises(Exception, match="(?i)decrease|failed"):
        online.run_to_table(online.online_decisions(stream, SPEC), str(tmp_path / "out"))


def _events(folder, parts):
    """One file per part, in the order in which the stream reads them."""
    import os

    for number, times in enumerate(parts):
        rows = [(k % 2, pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(minutes=m)) for k, m in enumerate(times)]
        path = folder / f"part-{number}.parquet"
        pd.DataFrame(rows, columns=[C.SUBJECT, "at"]).astype({"at": "datetime64[us, UTC]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def _stream(spark, folder):
    return online.read_event_stream(spark, str(folder), spark.read.parquet(str(folder)).schema)


def test_windows_open_at_the_end_are_closed(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    # 50 comes after 55 but within the lateness.
    _events(source, [[1, 2, 55], [50, 70, 71]])
    out = online.run_closed(_stream(spark, source), lambda e: online.tumbling_epochs(e, "1 hour", "30 minutes"), str(tmp_path / "out"))
    base = 1_704_067_200
    want = [(0, base + 3600, 3), (0, base + 7200, 1), (1, base + 3600, 1), (1, base + 7200, 1)]
    assert sorted((r[C.SUBJECT], r[C.DECISION_TIME], r[C.SAMPLES]) for r in out.collect()) == want
    sessions = online.run_closed(_stream(spark, source), lambda e: online.session_leases(e, "20 minutes", "30 minutes"), str(tmp_path / "s"))
    assert sum(r["n_reports"] for r in sessions.collect()) == 6


def test_late_reports_fail_the_run(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _events(source, [[1, 2], [600], [601], [3]])
    with pytest.raises(TraceError, match="late"):
        online.run_to_table(online.tumbling_epochs(_stream(spark, source), "1 hour", "30 minutes"), str(tmp_path / "out"))


BASE = 1_704_067_200


def _reports(folder, rows, parts):
    """Files of (entity, lease, decision time, score, at); rows are dealt over the parts in order.

    Event times lie after 1970, where the watermark starts.
    """
    import os

    for number, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        pdf = pd.DataFrame([rows[i] for i in part], columns=[C.SUBJECT, C.LEASE, C.DECISION_TIME, C.SCORE])
        pdf["at"] = pd.to_datetime(((BASE + pdf[C.DECISION_TIME]) * 1e6).astype("int64"), unit="us", utc=True).astype("datetime64[us, UTC]")
        path = folder / f"part-{number}.parquet"
        pdf.to_parquet(path)
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.mark.parametrize("parts", [1, 5])
def test_decisions_do_not_depend_on_triggers(spark, tmp_path, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    rng = np.random.default_rng(8)
    score = lambda i: None if i % 9 == 4 else float("nan") if i % 11 == 7 else float(np.round(rng.random(), 2))
    rows = [(int(rng.integers(0, 3)), f"L{i // 60}", float(i), score(i)) for i in range(150)]
    # Out of order by up to eight seconds, within the lateness; the last slice is closed by the end of the stream.
    shuffled = [rows[i] for i in np.argsort(np.arange(len(rows)) + rng.uniform(0, 8, len(rows)))]
    source = tmp_path / "in"
    source.mkdir()
    _reports(source, shuffled, parts)
    stream = online.read_event_stream(spark, str(source), spark.read.parquet(str(source)).schema)
    build = lambda e: online.ordered_decisions(e, SPEC, 7.0, "10 seconds")
    got = online.run_closed(stream, build, str(tmp_path / "out")).collect()
    assert len(got) == len(rows)
    for subject in range(3):
        own = [(r[1], r[2], r[3]) for r in rows if r[0] == subject]
        want = walk_controller(SPEC.rule(), own)
        mine = sorted((r for r in got if r[C.SUBJECT] == subject), key=lambda r: r[C.DECISION_TIME])
        assert [(r["previous_state"], r["state"], r["lifecycle_start"]) for r in mine] == [(w[0], w[1], w[3]) for w in want]


def test_reports_behind_a_folded_slice_fail_the_run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    source = tmp_path / "in"
    source.mkdir()
    _reports(source, [(1, "L", 5.0, 0.1), (1, "L", 90.0, 0.1), (1, "L", 91.0, 0.1), (1, "L", 6.0, 0.1)], 4)
    stream = online.read_event_stream(spark, str(source), spark.read.parquet(str(source)).schema)
    with pytest.raises(TraceError, match="late"):
        online.run_closed(stream, lambda e: online.ordered_decisions(e, SPEC, 7.0, "10 seconds"), str(tmp_path / "out"))


def test_chain_of_epochs_leases_and_decisions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    rng = np.random.default_rng(9)
    # Entity 1 is silent from 40 to 75: a second lease.
    rows = [(k % 2, "", float(t), float(np.round(rng.random(), 2))) for k, t in enumerate(range(120)) if k % 2 == 0 or not 40 < t < 75]
    source = tmp_path / "in"
    source.mkdir()
    _reports(source, rows, 4)
    stream = online.read_event_stream(spark, str(source), spark.read.parquet(str(source)).schema)
    stream = stream.select(C.SUBJECT, C.SCORE, "at")
    build = lambda e: online.chained_decisions(e, SPEC, "5 seconds", 20.0, 12.0, "3 seconds")
    got = online.run_closed(stream, build, str(tmp_path / "out")).collect()
    for subject in range(2):
        epochs: dict[float, tuple[float, float, float]] = {}
        for _, _, t, x in (r for r in rows if r[0] == subject):
            end = (t // 5 + 1) * 5
            epochs[end] = (epochs.get(end, (t,))[0], t, x)
        number, before, own = 0, None, []
        for end, (first, last, x) in sorted(epochs.items()):
            number += before is not None and first - before > 20.0
            before = last
            own.append((f"{subject}:{number}", end, x))
        want = walk_controller(SPEC.rule(), own)
        mine = sorted((r for r in got if r[C.SUBJECT] == subject), key=lambda r: r[C.DECISION_TIME])
        assert [(r[C.LEASE], r[C.DECISION_TIME] - BASE) for r in mine] == [o[:2] for o in own]
        assert [(r["previous_state"], r["state"], r["lifecycle_start"]) for r in mine] == [(w[0], w[1], w[3]) for w in want]
    assert {r[C.LEASE] for r in got} == {"0:0", "1:0", "1:1"}


class _Store:
    """A state store in memory: three states that share no keys, and the timers."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return self

    def getValueState(self, name, *_):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getValue(self, key):  # noqa: N802
        return self.values.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.values[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.values[key]

    def exists(self):
        return None in self.values

    def get(self):
        return self.values[None]

    def update(self, value):
        self.values[None] = value


@pytest.mark.parametrize("gap", [None, 3.0])
def test_a_slice_costs_one_timer_whatever_its_entities(gap):
    rng = np.random.default_rng(10)
    store = _Store()
    controller = online.OrderedController(SPEC, 10_000, gap)
    controller.init(store)
    rows = [(int(s), f"L{t // 12}", float(t), float(np.round(rng.random(), 2))) for s in range(300) for t in range(25) if rng.random() < 0.7]
    frame = pd.DataFrame([rows[i] for i in rng.permutation(len(rows))], columns=[C.SUBJECT, C.LEASE, C.DECISION_TIME, C.SCORE])
    frame = frame.assign(at_ms=(frame[C.DECISION_TIME] * 1000).astype("int64"), first_s=frame[C.DECISION_TIME], last_s=frame[C.DECISION_TIME])
    assert list(controller.handleInputRows((0,), iter([frame[:1000], frame[1000:]]), None)) == []
    assert sorted(store.timers) == [10_000, 20_000, 30_000]

    class Expired:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    got = pd.concat([out for at in sorted(store.timers) for out in controller.handleExpiredTimer((0,), None, Expired(at))])
    assert len(got) == len(rows) and set(store.values) == {None}
    for subject, mine in got.sort_values(C.DECISION_TIME).groupby(C.SUBJECT):
        own, number, before = [], 0, None
        for _, lease, t, x in sorted((r for r in rows if r[0] == subject), key=lambda r: r[2]):
            number += gap is not None and before is not None and t - before > gap
            before = t
            own.append((lease if gap is None else f"{subject}:{number}", t, x))
        want = walk_controller(SPEC.rule(), own)
        assert mine[C.LEASE].tolist() == [o[0] for o in own]
        shown = list(zip(mine["previous_state"], mine["state"], mine["lifecycle_start"]))
        assert shown == [(w[0], w[1], w[3]) for w in want]
