"""Causal tumbling epochs and their label annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import TraceRule
from pulsegate.functions.scalars import bin_index, colon_key, mask_labels
from pulsegate.operators.segmentation import segment_leases
from pulsegate.operators.splits import distinct_with_null
from pulsegate.schema import (
    CONSTANT_COLUMNS,
    CONTEXTS,
    IDENTIFIERS,
    TARGETS,
    TRACE_ONTOLOGY,
    Ontology,
    TraceError,
)

_NOT_FEATURES = {*IDENTIFIERS, *TARGETS, "timestamp", "mob_pattern"}
MASK = "__label_mask"


def default_features(df: DataFrame) -> list[str]:
    """Numeric columns that are not ids, targets, constants, raw time or derived keys."""
    derived = {C.ROW, C.TIME, C.BLOCK, C.LEASE_SEQUENCE, C.LEASE}
    skip = _NOT_FEATURES | set(CONSTANT_COLUMNS) | derived
    return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def label_mask(label: str, ontology: Ontology) -> Column:
    """Bit of a label; NULL labels have no bit and unknown labels fail the job."""
    bits = F.create_map(*[x for i, n in enumerate(ontology.labels) for x in (F.lit(n), F.lit(1 << i))])
    bit = F.element_at(bits, F.col(label))
    bad = F.raise_error(F.concat(F.lit("unknown label "), F.col(label))).cast("int")
    return F.when(F.col(label).isNull(), F.lit(0)).when(bit.isNotNull(), bit).otherwise(bad)


def causal_epochs(
    df: DataFrame,
    epoch_seconds: float = 1.0,
    features: Sequence[str] | None = None,
    contexts: Sequence[str] = CONTEXTS,
    ontology: Ontology | None = TRACE_ONTOLOGY,
    passthrough: Sequence[str] = (),
    label: str = "label",
) -> DataFrame:
    """One row per lease and occupied epoch.

    Features are the last report of the epoch, contexts the first; ``decision_time_s`` is
    the right edge.  Empty epochs are not made up.  Labels are combined as a bit mask, so
    the whole aggregate merges map-side and an epoch's state has a fixed size.
    ``passthrough`` columns must be functions of the block (such as its split).
    """
    features = default_features(df) if features is None else list(features)
    absent = sorted(set(features) - set(df.columns))
    forbidden = sorted(set(features) & _NOT_FEATURES)
    if absent or forbidden:
        raise TraceError(f"unusable epoch features: absent {absent}, forbidden {forbidden}")
    contexts = [c for c in contexts if c in df.columns]
    at = F.struct(C.TIME, C.ROW)
    keys = [C.BLOCK, C.LEASE, C.SUBJECT, *passthrough, C.EPOCH_START]
    binned = df.withColumn(C.EPOCH_START, bin_index(C.TIME, epoch_seconds).cast("double") * F.lit(float(epoch_seconds)))

    aggs = [
        F.count(F.lit(1)).alias(C.SAMPLES),
        F.min(C.TIME).alias("first_event_time_s"),
        F.max(C.TIME).alias("last_event_time_s"),
    ]
    if features:
        aggs.append(F.max_by(F.struct(*features), at).alias("__last"))
    if contexts:
        aggs.append(F.min_by(F.struct(*contexts), at).alias("__first"))
        aggs += [distinct_with_null(c).alias(f"{c}_n_unique") for c in contexts]
    if ontology:
        aggs.append(F.bit_or(label_mask(label, ontology)).alias(MASK))
    epochs = binned.groupBy(*keys).agg(*aggs)
    out = {f: F.col("__last")[f] for f in features} | {c: F.col("__first")[c] for c in contexts}
    if ontology:
        out |= {
            C.LABELS: mask_labels(MASK, ontology.labels, sorted(ontology.labels)),
            "target_observed": F.col(MASK) != 0,
            C.IS_ATTACK: F.col(MASK).bitwiseAND(F.lit(ontology.attack_mask)) != 0,
        }
    out |= {
        C.DECISION_TIME: F.col(C.EPOCH_START) + F.lit(float(epoch_seconds)),
        C.DURATION: F.lit(float(epoch_seconds)),
    }
    return epochs.withColumns(out).drop("__last", "__first", MASK)


def lease_epochs(
    df: DataFrame,
    rule: TraceRule,
    features: Sequence[str] | None = None,
    contexts: Sequence[str] = (),
    ontology: Ontology | None = TRACE_ONTOLOGY,
    passthrough: Sequence[str] = (),
    label: str = "label",
) -> DataFrame:
    """Leases and causal epochs together, from rows that know their block.

    Reports of one epoch are closer than ``epoch_seconds``; while that is below the lease
    gap no lease can open inside an epoch, so leases are read off the first and last event
    of neighbouring epochs.  Reports are then combined map-side and shuffled once, and the
    lease pass sees at most one row per block, entity and epoch.
    """
    if rule.epoch_seconds > 0.999 * rule.lease_gap_seconds:
        leased = segment_leases(df, rule.lease_gap_seconds)
        return causal_epochs(leased, rule.epoch_seconds, features, contexts, ontology, passthrough, label)
    known = F.when(F.col(C.SUBJECT).isNotNull(), F.col(C.SUBJECT)).otherwise(
        F.raise_error(F.lit("entity id cannot be NULL")).cast(df.schema[C.SUBJECT].dataType)
    )
    rows = df.withColumns({C.SUBJECT: known, C.LEASE: F.lit("")})
    epochs = causal_epochs(rows, rule.epoch_seconds, features, contexts, ontology, passthrough, label).drop(C.LEASE)
    return open_leases(epochs, rule.lease_gap_seconds)


def open_leases(epochs: DataFrame, lease_gap_seconds: float | Column, more: Sequence[str] = ()) -> DataFrame:
    """Number the leases of each block and entity from its epochs' first and last events."""
    limit = lease_gap_seconds if isinstance(lease_gap_seconds, Column) else F.lit(float(lease_gap_seconds))
    inside = Window.partitionBy(C.BLOCK, C.SUBJECT, *more).orderBy(C.EPOCH_START)
    silence = F.col("first_event_time_s") - F.lag("last_event_time_s").over(inside)
    opens = F.coalesce(silence > limit, F.lit(False)).cast("long")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    counted = epochs.withColumn("__open", opens).withColumn(C.LEASE_SEQUENCE, F.sum("__open").over(upto)).drop("__open")
    return counted.withColumn(C.LEASE, colon_key(C.BLOCK, C.SUBJECT, C.LEASE_SEQUENCE))


def sweep_leases(epochs: DataFrame, timeouts: Sequence[float], column: str = "lease_timeout_s") -> DataFrame:
    """Re-cut the leases of the same epochs under several timeouts, in one plan.

    Epochs do not depend on the lease timeout, so they are aggregated once and repeated
    per timeout; lease ids carry the timeout to stay distinct.
    """
    if any(t <= 0 for t in timeouts):
        raise ValueError("lease timeouts must be positive")
    listed = F.array(*[F.lit(float(t)) for t in timeouts])
    cut = open_leases(epochs.withColumn(column, F.explode(listed)), F.col(column), [column])
    return cut.withColumn(C.LEASE, F.concat(C.LEASE, F.lit("@"), F.col(column).cast("string")))


def attack_columns(df: DataFrame, ontology: Ontology = TRACE_ONTOLOGY) -> DataFrame:
    """``attack_<slug>`` flags, number of attack types and the mixed flag."""
    flags = {f"attack_{ontology.slug(a)}": F.array_contains(C.LABELS, a) for a in ontology.attacks}
    count = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return df.withColumns(flags | {"attack_types_in_epoch": count, "mixed_attack_epoch": count > 1})


def annotate_labels(df: DataFrame, ontology: Ontology = TRACE_ONTOLOGY) -> DataFrame:
    """Multi-hot and mixed-label annotations of ``labels_in_epoch``.

    An empty list, a NULL, an unknown label or a contradicting ``is_attack_epoch`` fails the job.
    """
    known = F.array(*map(F.lit, ontology.labels))
    labels = F.col(C.LABELS)
    ordered = F.filter(known, lambda x: F.array_contains(labels, x))
    attacks = F.filter(F.array(*map(F.lit, ontology.attacks)), lambda x: F.array_contains(labels, x))
    unknown = F.size(F.array_except(labels, known)) > 0
    empty = labels.isNull() | (F.size(labels) == 0)
    computed = F.size(attacks) > 0
    bad = empty | F.exists(labels, lambda x: x.isNull()) | unknown
    if C.IS_ATTACK in df.columns:
        bad = bad | F.col(C.IS_ATTACK).isNull() | (F.col(C.IS_ATTACK) != computed)
    checked = F.when(bad, F.raise_error(F.lit("epoch labels are empty, unknown or inconsistent")).cast("boolean"))
    n_attacks = F.size(attacks)
    out = {
        C.IS_ATTACK: checked.otherwise(computed),
        "labels_normalized": ordered,
        "attack_types": attacks,
        "label_type_count": F.size(ordered),
        "attack_type_count": n_attacks,
        "mixed_label_epoch": F.size(ordered) > 1,
        "mixed_attack_epoch": n_attacks > 1,
        "exclusive_attack_type": F.when(n_attacks == 1, F.element_at(attacks, 1)).when(n_attacks > 1, C.MIXED_ATTACK),
        "attack_type_key": F.when(n_attacks > 0, F.array_join(attacks, "|")),
    }
    out |= {f"attack__{ontology.slug(a)}": F.array_contains(labels, a) for a in ontology.attacks}
    return df.withColumns(out)


def attack_streams(ontology: Ontology = TRACE_ONTOLOGY) -> list[tuple[str, str]]:
    """``(stream name, mask column)``: any attack, each type, mixed."""
    typed = [(a, f"attack__{ontology.slug(a)}") for a in ontology.attacks]
    return [(C.ANY_ATTACK, C.IS_ATTACK), *typed, (C.MIXED_ATTACK, "mixed_attack_epoch")]
