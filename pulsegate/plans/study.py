"""The pipeline bound to the event table: one object per query, stages as properties."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import CandidateSpec, SplitRule, TraceRule
from pulsegate.operators.controllers import action_trace, explode_candidates, replay_arrays
from pulsegate.operators.episodes import epoch_episodes, mark_report_islands, mark_streams
from pulsegate.operators.epochs import annotate_labels, lease_epochs
from pulsegate.operators.metrics import with_previous_attack
from pulsegate.operators.segmentation import segment_blocks, segment_leases
from pulsegate.operators.splits import annotate_novelty
from pulsegate.sources.events import EVENT_ONTOLOGY, read_reports

# Event time scales: users report every few hours, so epochs are 4 h and blocks 5 days.
RULE = TraceRule(gap_seconds=2400.0, max_block_seconds=432000.0, lease_gap_seconds=129600.0, epoch_seconds=14400.0)
# One-day blocks give the block bootstrap some thirty clusters.
DAILY = TraceRule(gap_seconds=2400.0, max_block_seconds=86400.0, lease_gap_seconds=43200.0, epoch_seconds=14400.0)
# 2024-01-13, 2024-01-19 and 2024-01-25, 00:00 UTC.
SPLITS = SplitRule(cut_times_s=(1705104000.0, 1705622400.0, 1706140800.0))
EPOCH = RULE.epoch_seconds
DELAY_CAP_S = 30.0 * 3600.0

LOCKED = (
    CandidateSpec(
        "ewma-locked", "ewma", "ewma", {"restrict_threshold": 0.55, "isolate_threshold": 0.7, "tau_s": 2.0 * EPOCH}
    ),
    CandidateSpec(
        "n_report-locked",
        "n_report",
        "n_report",
        {"restrict_threshold": 0.5, "isolate_threshold": 0.65, "entry_reports": 2, "recovery_reports": 2},
    ),
    CandidateSpec(
        "proposed-locked",
        "proposed",
        "asymmetric_sequential",
        {
            "restrict_enter": 0.6,
            "restrict_exit": 0.5,
            "isolate_enter": 0.75,
            "isolate_exit": 0.65,
            "entry_reports": 1,
            "recovery_reports": 2,
            "min_restrict_hold_s": EPOCH,
            "min_isolate_hold_s": 2.0 * EPOCH,
        },
    ),
    CandidateSpec(
        "stateless-locked",
        "stateless_reference",
        "stateless",
        {"restrict_threshold": 0.6, "isolate_threshold": 0.75},
    ),
    CandidateSpec(
        "symmetric-locked",
        "symmetric_hysteresis",
        "symmetric_hysteresis",
        {"restrict_center": 0.55, "isolate_center": 0.55, "half_width": 0.05},
    ),
)
PROPOSED, REFERENCE = "proposed-locked", "stateless-locked"
STATELESS_PAIRS = ((0.5, 0.65), (0.6, 0.75), (0.7, 0.8))


def stateless_specs() -> list[CandidateSpec]:
    return [
        CandidateSpec(
            f"stateless-{i}", "stateless", "stateless", {"restrict_threshold": r, "isolate_threshold": s}
        )
        for i, (r, s) in enumerate(STATELESS_PAIRS)
    ]


class Study:
    """Lazy stages over one event table."""

    def __init__(self, spark: SparkSession, sf_dir: str, rule: TraceRule = RULE):
        self.spark, self.sf_dir, self.rule = spark, sf_dir, rule
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @cached_property
    def reports(self) -> DataFrame:
        """Reports with a four-valued mobility pattern derived from the context id."""
        df = read_reports(self.spark, self.sf_dir)
        return df.withColumn("mob_pattern", F.concat(F.lit("m"), F.floor(F.col("id_ue") / 25).cast("string")))

    @cached_property
    def blocked(self) -> DataFrame:
        return segment_blocks(self.reports, self.rule, SPLITS)

    @cached_property
    def prepared(self) -> DataFrame:
        return segment_leases(self.blocked, self.rule.lease_gap_seconds)

    @cached_property
    def epochs(self) -> DataFrame:
        """Annotated, split-labelled epochs scored by their last report."""
        raw = lease_epochs(self.blocked, self.rule, ["value", C.SCORE], (), EVENT_ONTOLOGY, (C.SPLIT,))
        return annotate_labels(raw, EVENT_ONTOLOGY)

    def split(self, name: str) -> DataFrame:
        return self.epochs.where(F.col(C.SPLIT) == name)

    @cached_property
    def marked(self) -> DataFrame:
        return self.mark(self.epochs)

    def mark(self, epochs: DataFrame) -> DataFrame:
        """Epochs with label-derived run, stream and neighbour marks."""
        order = [C.DECISION_TIME]
        islands = mark_report_islands(with_previous_attack(epochs, order=order), order)
        return mark_streams(islands, EVENT_ONTOLOGY, 0.0, order)

    @cached_property
    def replayed(self) -> DataFrame:
        """Marked epochs with the locked policies' decision arrays.

        Metrics, contributions and episodes of one query all read it, so it is kept (in
        memory, then on disk); lost blocks are recomputed from the events.
        """
        return replay_arrays(self.marked, LOCKED, order=[C.DECISION_TIME]).persist()

    def trace(self, specs=LOCKED, epochs: DataFrame | None = None) -> DataFrame:
        """Long action table; without ``epochs``, of the locked policies on all marked epochs."""
        if epochs is None:
            return explode_candidates(self.replayed, LOCKED)
        return action_trace(epochs, specs, order=[C.DECISION_TIME])

    @cached_property
    def episodes(self) -> DataFrame:
        return epoch_episodes(self.trace(), delay_cap_s=DELAY_CAP_S)

    @cached_property
    def novelty(self) -> DataFrame:
        return annotate_novelty(self.epochs, SPLITS)
