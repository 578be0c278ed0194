"""All command-line stages on a synthetic raw trace, checked against pandas where simple."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from pulsegate import columns as C
from pulsegate.config import SplitRule
from pulsegate.plans.stages import STAGES, Workspace
from pulsegate.sources.trace_csv import read_header, scan_trace, with_source_row
from pulsegate.schema import TRACE_COLUMNS, TraceError
from tests.trace_data import CUTS, write_trace

ORDER = (
    "data manifest prepare capture-audit matched-search strict-selection confirmatory inference repro-audit "
    "lease-sensitivity benchmark report"
).split()


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    source = str(root / "trace.csv")
    raw = write_trace(source)
    w = Workspace(
        spark, str(root / "out"), source, splits=SplitRule(cut_times_s=CUTS), budgets=(0.05, 0.2), replicates=200, proposed_budget=0.2
    )
    return w, raw


def test_source_scan(space, spark):
    w, raw = space
    assert read_header(spark, w.source) == list(TRACE_COLUMNS)
    rows = with_source_row(scan_trace(spark, w.source, ["mac_rnti", "timestamp"])).orderBy(C.ROW).toPandas()
    assert rows[C.ROW].tolist() == list(range(len(raw)))
    assert rows["timestamp"].tolist() == raw["timestamp"].tolist()


def test_ragged_rows_fail(space, spark, tmp_path):
    w, _ = space
    bad = tmp_path / "bad.csv"
    lines = open(w.source).read().splitlines()[:3]
    bad.write_text("\n".join([*lines, "1;2;3"]))
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_trace(spark, str(bad)).collect()


def test_audit_finds_violations(space, spark, tmp_path):
    w, raw = space
    broken = raw.copy()
    broken.loc[broken.index[0], "rf_o"] = 9
    broken.loc[broken.index[1], "label"] = "mystery"
    broken = pd.concat([broken, broken.tail(1)])
    path = tmp_path / "broken.csv"
    broken.to_csv(path, sep=";", index=False)
    from pulsegate.operators.audit import validate_trace

    with pytest.raises(TraceError) as info:
        validate_trace(scan_trace(spark, str(path)))
    text = str(info.value)
    assert "constant__rf_o=1" in text and "unknown_label_rows=1" in text and "duplicate_members=2" in text


def test_every_stage(space):
    w, raw = space
    results = {name: STAGES[name](w) for name in ORDER}
    assert results["data"]["n_rows"] == len(raw)
    assert results["data"]["entities"] == raw["mac_rnti"].nunique()
    assert set(results["prepare"]["splits"]) == set(w.splits.names)
    epochs = w.read("epochs")
    samples = epochs.agg({C.SAMPLES: "sum"}).first()[0]
    assert samples == len(raw)
    assert results["repro-audit"]["status"] == "pass"
    assert results["repro-audit"]["checks"]
    trace, test = w.read("action_trace"), w.read("scores").where("split = 'test'")
    assert trace.count() == test.count() * len(w.lock().specs)
    gates = results["inference"]["primary_gates"]
    assert {g["status"] for g in gates} <= {"pass", "fail", "unknown"}
    for name in ("clusters", "seen", "unseen"):
        found = {r.metric: r for r in w.read(f"inference_{name}").collect()}
        assert len(found) == 7 and {r.requested_replicates for r in found.values()} == {w.replicates}
    rules = w.read("inference_episode_definitions").toPandas().pivot(index="candidate", columns="definition", values="episode_count")
    assert (rules["no unobserved time bridged"] >= rules["primary gap"]).all()
    primary = w.read("attack_episodes").where("attack_type = '__any_attack__'").groupBy("candidate").count().toPandas()
    assert dict(zip(primary["candidate"], primary["count"])) == rules["primary gap"].to_dict()
    assert w.read("stratified_metrics").where("stratum LIKE 'mobility_%'").select("stratum").distinct().count() > 1
    assert results["lease-sensitivity"]["rows"] == 5 * len(w.lock().specs)
    assert json.dumps(results["report"])
    diagnostics = w.read("risk_diagnostics").where("analysis = 'split'").toPandas().set_index("split")
    assert diagnostics.loc["test", "auroc"] > 0.7
    heldout = w.spark.read.option("header", True).csv(w.path("table_heldout.csv"))
    assert heldout.count() == len(w.lock().specs)
    attacks = w.spark.read.option("header", True).csv(w.path("table_per_attack.csv")).toPandas()
    assert set(attacks["attack_type"]) == set(w.ontology.attacks)
    for r in attacks.itertuples():
        assert float(r.proposal_exposure_pct) - float(r.reference_exposure_pct) == pytest.approx(float(r.exposure_difference_pp), abs=1e-3)
    assert w.read("matched_candidates").where("benign_friction > friction_budget + 1e-12").count() == 0
