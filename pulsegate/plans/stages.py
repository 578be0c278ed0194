"""The thirteen command-line stages over trace files and stage tables.

Every stage reads the tables of earlier stages under ``root`` and writes its own; nothing
but parameters, counts and small JSON documents passes through the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import (
    FRICTION_BUDGETS,
    TUNING_SPLIT,
    CandidateSpec,
    SelectionTolerances,
    SpecLock,
    SplitRule,
    TraceRule,
)
from pulsegate.operators import audit, calibration, contributions, grouping, integrity, reports, resampling, selection, splits
from pulsegate.operators.controllers import LEASE_KEYS, action_trace, explode_candidates, replay_arrays, replay_inputs
from pulsegate.operators.episodes import epoch_episodes, episode_strata, episode_summary, mark_streams, point_summary
from pulsegate.operators.epochs import annotate_labels, attack_columns, lease_epochs, sweep_leases
from pulsegate.operators.metrics import BY_CANDIDATE, action_metrics, mobility_stratum, novelty_strata, stratified_metrics
from pulsegate.operators.scoring import fit_platt, fit_risk_model, risk_diagnostics, save_model
from pulsegate.operators.segmentation import correct_chronology, prepare, segment_blocks
from pulsegate.schema import CONTEXTS, KPI_FEATURES, TRACE_ONTOLOGY, Ontology
from pulsegate.sources import tables
from pulsegate.sources.trace_csv import scan_trace

# Seconds of the lease-timeout sweep, of the delay cap and of unobserved time an episode bridges.
LEASE_TIMEOUTS_S = (5.0, 10.0, 30.0, 60.0, 300.0)
DELAY_CAP_S = 30.0
EPISODE_GAP_S = 30.0
ATTACK_GATES = resampling.PRIMARY_GATES[:3] + resampling.PRIMARY_GATES[4:]


@dataclass
class Workspace:
    """Where a run keeps its tables, and its cutting rules."""

    spark: SparkSession
    root: str
    source: str = ""
    rule: TraceRule = TraceRule()
    splits: SplitRule = SplitRule()
    ontology: Ontology = TRACE_ONTOLOGY
    budgets: Sequence[float] = FRICTION_BUDGETS
    replicates: int = 5000
    seed: int = 1729
    features: Sequence[str] = tuple(f for f in KPI_FEATURES if f != "samples_in_epoch")
    proposed_budget: float = 0.01

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(f"{name}.parquet"))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        tables.write_parquet(df, self.path(f"{name}.parquet"))
        return self.read(name)

    def document(self, name: str, payload: Any) -> dict[str, Any]:
        tables.write_json(self.path(f"{name}.json"), payload)
        return tables.json_ready(payload)

    def load(self, name: str) -> dict[str, Any]:
        return tables.read_json(self.path(f"{name}.json"))

    def raw(self) -> DataFrame:
        return scan_trace(self.spark, self.source)

    def tune(self) -> DataFrame:
        return self.read("scores").where(F.col(C.SPLIT) == TUNING_SPLIT)

    def lock(self) -> SpecLock:
        return SpecLock(**self.load("candidate_lock"))


def stage_data(w: Workspace) -> dict[str, Any]:
    """Audit the raw trace and count its blocks and leases."""
    report = audit.validate_trace(w.raw(), w.ontology)
    rows = prepare(w.raw(), w.rule, None, w.ontology)
    counts = rows.agg(
        F.count_distinct(C.BLOCK).alias("blocks"),
        F.count_distinct(C.LEASE).alias("leases"),
        F.count_distinct(C.SUBJECT).alias("entities"),
    ).first()
    return w.document("audit", {**report, **counts.asDict()})


def stage_manifest(w: Workspace) -> dict[str, Any]:
    """Assign whole blocks to splits and describe the assignment."""
    tables.refuse_overwrite(w.path("split_manifest.json"), w.source)
    rows = segment_blocks(correct_chronology(w.raw(), w.rule), w.rule)
    digest = tables.source_fingerprint(w.spark, w.source)
    found = splits.build_manifest(rows, w.rule, w.splits, w.ontology, w.source, digest, allow_empty_splits=True)
    return w.document("split_manifest", found)


def stage_prepare(w: Workspace) -> dict[str, Any]:
    """Epochs, risk model, calibration, scores and diagnostics."""
    rows = segment_blocks(correct_chronology(w.raw(), w.rule), w.rule, w.splits)
    epochs = lease_epochs(rows, w.rule, None, CONTEXTS, w.ontology, (C.SPLIT,))
    epochs = attack_columns(splits.annotate_novelty(epochs, w.splits), w.ontology)
    epochs = w.write("epochs", epochs)
    fitted = fit_risk_model(epochs, w.features, w.splits.names[0], seed=w.seed)
    model = fit_platt(fitted, epochs, w.splits.names[1]).with_tuning_partition(w.splits.names[2])
    save_model(model, w.path("risk_model.json"))
    drop = [f for f in w.features if f in epochs.columns]
    scores = w.write("scores", tables.check_scores(model.score(epochs).drop(*drop)))
    strata = [risk_diagnostics(scores, [C.SPLIT]), risk_diagnostics(scores, [C.SPLIT, C.NOVELTY])]
    w.write("risk_diagnostics", reports.robustness_table(dict(zip(("split", "novelty"), strata))))
    counts = scores.groupBy(C.SPLIT).agg(F.count(F.lit(1)).alias("epochs"), F.avg(F.col(C.IS_ATTACK).cast("int")).alias("attack"))
    return w.document("data_summary", {"splits": {r[C.SPLIT]: r.asDict() for r in counts.collect()}})


def stage_capture_audit(w: Workspace) -> dict[str, Any]:
    """Label-blind block audit, grouping candidates and the cluster map."""
    rows = prepare(w.raw(), w.rule, w.splits, None)
    grouped = w.write("grouped_blocks", grouping.grouping_candidates(grouping.summarize_blocks(rows)))
    mapping = grouping.cluster_mapping(grouped)
    tables.write_cluster_map(mapping, w.path("cluster_map.csv"), w.source)
    summary = [r.asDict() for r in grouping.candidate_summary(grouped).collect()]
    digest = tables.table_digest(mapping).first().asDict()
    quantiles = [r.asDict() for r in grouping.adjacency_quantiles(grouped).collect()]
    return w.document(
        "capture_audit", {"label_blind": True, "candidates": summary, "adjacency": quantiles, "mapping_digest": digest}
    )


def stage_broad_search(w: Workspace) -> dict[str, Any]:
    """Metrics of the broad grid and the within-family choice per budget."""
    specs = calibration.broad_grid(calibration.threshold_pairs(w.tune()), w.rule.epoch_seconds)
    metrics = w.write("broad_candidates", calibration.candidate_metrics(w.tune(), specs, delay_cap_s=DELAY_CAP_S))
    chosen = w.write("broad_selection", selection.within_family(metrics, w.budgets))
    w.document("broad_specs", [s.to_dict() for s in specs])
    return w.document("broad_summary", {"candidates": len(specs), "selected": chosen.count()})


def stage_matched_search(w: Workspace) -> dict[str, Any]:
    """Calibrate every template to every budget by bisection, then match on budget."""
    tune = w.tune()
    grid = calibration.data_templates(tune, w.rule.epoch_seconds)
    found = calibration.bisect_thresholds(calibration.probe_table(tune), grid, w.budgets)
    specs = [c.spec for c in found]
    metrics = calibration.candidate_metrics(tune, specs, delay_cap_s=DELAY_CAP_S)
    metrics = w.write("matched_candidates", calibration.with_budgets(metrics, found))
    w.write("matched_selection", selection.matched_selection(metrics))
    w.document("matched_specs", {s.candidate: s.to_dict() for s in specs})
    counts = metrics.groupBy(C.FAMILY, "friction_budget").count().collect()
    return w.document("matched_summary", {"candidates": len(specs), "per_family": [r.asDict() for r in counts]})


def stage_strict_selection(w: Workspace) -> dict[str, Any]:
    """Stateless references and the audited cascade; locks the chosen policies."""
    tolerances = SelectionTolerances()
    refs = w.write("stateless_references", calibration.stateless_references(w.tune(), w.budgets, tolerances))
    chosen = selection.cascade_selection(w.read("matched_candidates"), refs, tolerances)
    chosen = w.write("strict_selection", chosen)
    at_budget = F.abs(F.col("friction_budget") - F.lit(w.proposed_budget)) < 1e-12
    known = w.load("matched_specs")
    rows = chosen.where(at_budget & F.col(C.CANDIDATE).isNotNull()).collect()
    specs = [CandidateSpec(**known[r[C.CANDIDATE]]) for r in rows]
    for r in refs.where(at_budget).collect():
        level = r["restrict_threshold"]
        both = {"restrict_threshold": level, "isolate_threshold": level}
        specs.append(CandidateSpec(r[C.CANDIDATE], "stateless_reference", "stateless", both))
    lock = SpecLock.of(specs)
    w.document("candidate_lock", asdict(lock))
    return w.document("strict_summary", {"statuses": [r.asDict() for r in chosen.select("friction_budget", C.FAMILY, "status").collect()]})


def stage_confirmatory(w: Workspace) -> dict[str, Any]:
    """Locked evaluation of the held-out split: trace, metrics, episodes, contributions."""
    lock, order = w.lock(), [C.DECISION_TIME]
    test = annotate_labels(w.read("scores").where(F.col(C.SPLIT) == w.splits.evaluation), w.ontology)
    marked = mark_streams(test, w.ontology, EPISODE_GAP_S, order)
    trace = w.write("action_trace", explode_candidates(replay_arrays(marked, lock.specs, order=order), lock.specs, lock.sha256))
    labels = [(s.candidate, s.family) for s in lock.specs]
    w.write("aggregate_metrics", action_metrics(trace))
    mobility = [mobility_stratum()] if "mob_pattern" in trace.columns else []
    w.write("stratified_metrics", stratified_metrics(trace, novelty_strata(trace), mobility))
    episodes = w.write("attack_episodes", epoch_episodes(trace, delay_cap_s=DELAY_CAP_S))
    w.write("episode_strata", episode_strata(episodes))
    w.write("episode_summary", episode_summary(episodes))
    w.write("action_contributions", contributions.action_contributions(trace))
    w.write("attack_contributions", contributions.attack_contributions(trace, episodes, labels, w.ontology))
    counts = test.agg(F.count(F.lit(1)).alias("epochs"), F.count_distinct(C.BLOCK).alias("blocks")).first()
    return w.document("run_manifest", {"candidate_lock_sha256": lock.sha256, **counts.asDict()})


def _policies(w: Workspace) -> tuple[str, str]:
    by_family = {s.family: s.candidate for s in w.lock().specs}
    return by_family["proposed"], by_family["stateless_reference"]


def primary_intervals(w: Workspace, attack: str = C.ANY_ATTACK) -> DataFrame:
    """Intervals of one attack stream on the evaluated blocks."""
    action = w.read("action_contributions")
    return contrast_intervals(w, action, w.read("attack_contributions"), w.read("attack_episodes"), action, attack)


def contrast_intervals(
    w: Workspace, action: DataFrame, attacks: DataFrame, episodes: DataFrame, blocks: DataFrame, attack: str = C.ANY_ATTACK
) -> DataFrame:
    """Additive, median and single-policy intervals; ``blocks`` names the blocks to draw."""
    proposed, reference = _policies(w)
    universe = resampling.block_universe(blocks).persist()
    n = universe.count()
    draws = resampling.generator_draws(w.spark, w.replicates, n, w.seed)
    left = contributions.paired_grid(action, universe, proposed, reference, contributions.ACTION_VALUES)
    right = contributions.paired_grid(attacks, universe, proposed, reference, contributions.ATTACK_VALUES, attack)
    present = ("p_present", "r_present")
    grid = left.drop(*present).join(right.drop(*present), C.BLOCK).join(universe, C.BLOCK).persist()
    values = resampling.contrast_draws(grid, draws)
    additive = resampling.intervals(resampling.contrast_estimates(grid), values, w.replicates)
    shown = episodes.where(F.col("attack_type") == attack)
    pairs = resampling.paired_episodes(shown, proposed, reference).persist()
    median = resampling.intervals(
        resampling.median_delay_estimate(pairs), resampling.median_delay_draws(pairs, universe, draws), w.replicates
    )
    ratio = resampling.Contrast("proposed_benign_friction", "benign_contained_time_s", "benign_time_s")
    single = resampling.single_ratio_grid(action, universe, proposed, ratio.numerator, ratio.denominator)
    single = single.join(universe, C.BLOCK)
    friction = resampling.intervals(
        resampling.contrast_estimates(single, [ratio]), resampling.contrast_draws(single, draws, [ratio]), w.replicates
    )
    return reports.robustness_table({"additive": additive, "median": median, "friction": friction})


# Fixed value: the coarser cluster of the sensitivity analysis.
SENSITIVITY_CLUSTER = "fixed_3600s_group"


def sensitivity_intervals(w: Workspace) -> dict[str, DataFrame]:
    """Primary intervals under coarser clusters, and on seen and on new entities."""
    action, attacks, episodes = (w.read(t) for t in ("action_contributions", "attack_contributions", "attack_episodes"))
    mapping = tables.read_cluster_map(w.spark, w.path("cluster_map.csv"))
    cluster = SENSITIVITY_CLUSTER

    def rolled(table: DataFrame, keys: Sequence[str]) -> DataFrame:
        return contributions.roll_up(table, mapping, cluster, keys).withColumnRenamed(cluster, C.BLOCK)

    coarse = rolled(action, [C.CANDIDATE])
    moved = contributions.roll_up_episodes(episodes, mapping, cluster)
    out = {"clusters": contrast_intervals(w, coarse, rolled(attacks, [C.CANDIDATE, "attack_type"]), moved, coarse)}
    trace = w.read("action_trace")
    if C.NOVELTY in trace.columns:
        labels = [(s.candidate, s.family) for s in w.lock().specs]
        for novelty in ("seen", "unseen"):
            own = trace.where(F.col(C.NOVELTY) == novelty)
            found = epoch_episodes(own, delay_cap_s=DELAY_CAP_S)
            both = contributions.attack_contributions(own, found, labels, w.ontology)
            out[novelty] = contrast_intervals(w, contributions.action_contributions(own), both, found, action)
    return out


def episode_definitions(w: Workspace) -> DataFrame:
    """Point summaries under other episode rules; recorded actions stay, only targets and runs change."""
    trace, keys = w.read("action_trace"), (C.CANDIDATE, *LEASE_KEYS)

    def summary(rows: DataFrame, gap: float, name: str) -> DataFrame:
        marked = mark_streams(rows, w.ontology, gap, [C.DECISION_TIME], keys)
        return point_summary(epoch_episodes(marked, delay_cap_s=DELAY_CAP_S)).withColumn("definition", F.lit(name))

    parts = [
        summary(trace.where(~F.col("mixed_attack_epoch")), EPISODE_GAP_S, "mixed attack epochs excluded"),
        summary(trace, 0.0, "no unobserved time bridged"),
        summary(trace, EPISODE_GAP_S, "primary gap"),
    ]
    return reduce(DataFrame.unionByName, parts)


def stage_inference(w: Workspace) -> dict[str, Any]:
    """Block-bootstrap intervals and gates: primary, per attack, coarser clusters, novelty; other episode definitions."""
    primary = w.write("inference_intervals", primary_intervals(w))
    gates = w.write("inference_gates", resampling.gate_decisions(primary, ATTACK_GATES))
    for name in w.ontology.attacks:
        w.write(f"inference_{Ontology.slug(name)}", primary_intervals(w, name))
    for name, table in sensitivity_intervals(w).items():
        w.write(f"inference_{name}", table)
    w.write("inference_episode_definitions", episode_definitions(w))
    decided = [r.asDict() for r in gates.collect()]
    return w.document("inference", {"primary_gates": decided, "intervals": [r.asDict() for r in primary.collect()]})


def stage_repro_audit(w: Workspace) -> dict[str, Any]:
    """Recompute keys, lags and aggregates from rows and compare."""
    lock = w.lock()
    trace, scores, episodes = w.read("action_trace"), w.read("scores"), w.read("attack_episodes")
    test = scores.where(F.col(C.SPLIT) == w.splits.evaluation)
    n = len(lock.specs)
    checks = integrity.check_table(
        [
            *integrity.score_checks(scores),
            *integrity.replay_checks(test),
            *integrity.action_checks(trace, test, n),
            *integrity.recompute_checks(trace, w.read("aggregate_metrics")),
            *integrity.episode_checks(episodes, n),
        ]
    )
    passed = integrity.require_all(w.write("integrity_checks", checks))
    stamped = trace.where(F.col("candidate_lock_sha256") != lock.sha256).limit(1).count() == 0
    if not stamped or w.load("run_manifest")["candidate_lock_sha256"] != lock.sha256:
        raise integrity.TraceError("action rows do not carry the candidate lock")
    digests = {t: tables.table_digest(w.read(t)).first().asDict() for t in ("scores", "action_trace", "attack_episodes")}
    return w.document("reproducibility", {"status": "pass", "checks": passed, "table_digests": digests})


def stage_lease_sensitivity(w: Workspace, timeouts: Sequence[float] = LEASE_TIMEOUTS_S) -> dict[str, Any]:
    """Locked replay under other lease timeouts, thresholds and scores unchanged."""
    lock, order = w.lock(), [C.DECISION_TIME]
    test = w.read("scores").where(F.col(C.SPLIT) == w.splits.evaluation)
    cut = annotate_labels(sweep_leases(test.drop(C.LEASE), timeouts), w.ontology)
    marked = mark_streams(cut, w.ontology, F.col("lease_timeout_s"), order)
    trace = action_trace(marked, lock, order=order)
    action = w.write("lease_action", action_metrics(trace, [*BY_CANDIDATE, "lease_timeout_s"]))
    keys = (C.BLOCK, C.SUBJECT, C.LEASE, "lease_timeout_s")
    summary = episode_summary(epoch_episodes(trace, delay_cap_s=DELAY_CAP_S, keys=keys), False, ["lease_timeout_s"])
    w.write("lease_episodes", reports.overall_episodes(summary))
    return w.document("lease_manifest", {"timeouts_s": list(timeouts), "rows": action.count(), "thresholds_retuned": False})


def stage_benchmark(w: Workspace, repetitions: int = 5) -> dict[str, Any]:
    """Timed replays of every locked policy on the held-out epochs."""
    test = replay_inputs(w.read("scores").where(F.col(C.SPLIT) == w.splits.evaluation)).persist()
    n, rows = test.count(), []
    for spec in w.lock().specs:
        for repetition in range(repetitions + 1):
            started = time.perf_counter()
            action_trace(test, [spec], order=[C.DECISION_TIME]).write.format("noop").mode("overwrite").save()
            if repetition:
                rows.append((spec.candidate, time.perf_counter() - started))
    test.unpersist()
    samples = w.spark.createDataFrame(rows, "candidate string, elapsed_s double")
    summary = reports.timing_summary(samples, [C.CANDIDATE])
    tables.write_report_csv(summary, w.path("benchmark_summary.csv"))
    medians = {c: statistics.median(t for name, t in rows if name == c) for c, _ in rows}
    return w.document("benchmark", {"epochs": n, "epochs_per_second": {c: n / t for c, t in medians.items()}})


def stage_report(w: Workspace) -> dict[str, Any]:
    """Report tables in publication units, as CSV."""
    out = {"heldout": reports.heldout_table(w.read("aggregate_metrics"), w.read("episode_summary"))}
    out["seen_unseen"] = reports.seen_unseen_table(w.read("stratified_metrics"))
    out["frontier"] = reports.frontier_table(w.read("strict_selection"), w.read("stateless_references"))
    lease = reports.lease_timeout_table(w.read("lease_action"), w.read("lease_episodes"))
    out |= {"lease_timeouts": lease, "lease_contrast": reports.timeout_contrast(lease)}
    streams = {C.ANY_ATTACK: "intervals", **{a: Ontology.slug(a) for a in w.ontology.attacks}}
    found = [w.read(f"inference_{tag}").withColumn("attack_type", F.lit(a)) for a, tag in streams.items()]
    out["robustness"] = reduce(DataFrame.unionByName, found)
    proposed, reference = _policies(w)
    classes = out["robustness"].where(F.col("attack_type") != C.ANY_ATTACK)
    out["per_attack"] = reports.per_attack_table(w.read("episode_summary"), classes, proposed, reference, w.ontology.attacks)
    digests = {}
    for name, df in out.items():
        tables.write_report_csv(df, w.path(f"table_{name}.csv"))
        digests[name] = tables.table_digest(tables.rounded_for_report(df)).first().asDict()
    return w.document("report_digest", {"tables": digests})


STAGES: dict[str, Callable[..., dict[str, Any]]] = {
    "data": stage_data,
    "manifest": stage_manifest,
    "prepare": stage_prepare,
    "capture-audit": stage_capture_audit,
    "broad-search": stage_broad_search,
    "matched-search": stage_matched_search,
    "strict-selection": stage_strict_selection,
    "confirmatory": stage_confirmatory,
    "inference": stage_inference,
    "repro-audit": stage_repro_audit,
    "lease-sensitivity": stage_lease_sensitivity,
    "benchmark": stage_benchmark,
    "report": stage_report,
}


def summary_line(name: str, result: dict[str, Any]) -> str:
    return json.dumps({"stage": name, "keys": sorted(result)}, sort_keys=True)


