"""Whole-block chronological splits, the split manifest and entity novelty."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import SplitRule, TraceRule
from pulsegate.functions.scalars import col
from pulsegate.schema import Ontology, TraceError


def split_name(block_end: Column | str, splits: SplitRule) -> Column:
    """Split of a block: the number of cuts strictly before its end."""
    passed = sum((F.when(col(block_end) > F.lit(float(c)), 1).otherwise(0) for c in splits.cut_times_s), F.lit(0))
    return F.element_at(F.array(*map(F.lit, splits.names)), passed + 1)


def distinct_with_null(c: str) -> Column:
    """Distinct count that counts NULL as a value."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def block_summary(df: DataFrame, time: str = C.TIME, subject: str = C.SUBJECT) -> DataFrame:
    """Start, end, rows and entities of every block."""
    return df.groupBy(C.BLOCK).agg(
        F.min(time).alias("start_s"),
        F.max(time).alias("end_s"),
        F.count(F.lit(1)).alias("n_rows"),
        distinct_with_null(subject).alias("n_numeric_rntis"),
    )


def assign_splits(blocks: DataFrame, splits: SplitRule) -> DataFrame:
    return blocks.withColumn(C.SPLIT, split_name("end_s", splits))


def attach_splits(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Join each row to its block's split; a row of an unassigned block fails the job."""
    joined = df.join(assignment.select(C.BLOCK, C.SPLIT), C.BLOCK, "left")
    missing = F.raise_error(F.lit("row belongs to a block without a split")).cast("string")
    return joined.withColumn(C.SPLIT, F.coalesce(F.col(C.SPLIT), missing))


def split_summary(df: DataFrame, time: str = C.TIME, subject: str = C.SUBJECT) -> DataFrame:
    """Bounds, blocks, rows and entities per split."""
    return df.groupBy(C.SPLIT).agg(
        F.min(time).alias("start_s"),
        F.max(time).alias("end_s"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(C.BLOCK).alias("n_blocks"),
        distinct_with_null(subject).alias("n_numeric_rntis"),
    )


def block_lists(assigned: DataFrame) -> DataFrame:
    """Ordered block ids per split, from the block table (one row per block)."""
    return assigned.groupBy(C.SPLIT).agg(F.array_sort(F.collect_list(C.BLOCK)).alias("block_ids"))


def reference_entities(df: DataFrame, splits: SplitRule, subject: str = C.SUBJECT) -> DataFrame:
    return df.where(F.col(C.SPLIT).isin(*splits.reference) & F.col(subject).isNotNull()).select(subject).distinct()


def evaluation_entities(df: DataFrame, splits: SplitRule, subject: str = C.SUBJECT) -> DataFrame:
    return df.where((F.col(C.SPLIT) == splits.evaluation) & F.col(subject).isNotNull()).select(subject).distinct()


def seen_entities(df: DataFrame, splits: SplitRule, subject: str = C.SUBJECT) -> DataFrame:
    return evaluation_entities(df, splits, subject).join(reference_entities(df, splits, subject), subject, "left_semi")


def unseen_entities(df: DataFrame, splits: SplitRule, subject: str = C.SUBJECT) -> DataFrame:
    return evaluation_entities(df, splits, subject).join(reference_entities(df, splits, subject), subject, "left_anti")


def annotate_novelty(
    df: DataFrame, splits: SplitRule, subject: str = C.SUBJECT, reference: DataFrame | None = None
) -> DataFrame:
    """Flag evaluation rows whose entity also occurs in a reference split of ``reference`` (``df`` itself).

    The join side is one row per entity; the rows of one heavy entity are a skewed join
    partition, which AQE splits.
    """
    known = reference_entities(df if reference is None else reference, splits, subject).withColumn("__known", F.lit(True))
    joined = df.join(known, subject, "left")
    seen = F.coalesce("__known", F.lit(False))
    evaluated = F.col(C.SPLIT) == splits.evaluation
    novelty = (
        F.when(F.col(C.SPLIT).isin(*splits.reference), "reference")
        .when(evaluated & seen, "seen")
        .when(evaluated, "unseen")
        .otherwise("not_evaluated")
    )
    return joined.withColumns({C.SEEN: F.when(evaluated, seen), C.NOVELTY: novelty}).drop("__known")


def check_blocks(assigned: DataFrame) -> DataFrame:
    """Violations of the block table: overlaps, late blocks in early splits."""
    order = Window.partitionBy(F.lit(0)).orderBy("start_s", C.BLOCK)
    return assigned.select(
        C.BLOCK, C.SPLIT, (F.col("start_s") < F.lag("end_s").over(order)).alias("overlaps_previous")
    ).agg(F.count_if(F.coalesce("overlaps_previous", F.lit(False))).alias("overlaps"))


def build_manifest(
    df: DataFrame,
    rule: TraceRule,
    splits: SplitRule,
    ontology: Ontology,
    source_path: str | None = None,
    source_fingerprint: str | None = None,
    allow_empty_splits: bool = False,
) -> dict[str, Any]:
    """JSON document describing the split.

    Only the block table and entity *counts* reach the driver; entity lists are tables
    (:func:`seen_entities`, :func:`unseen_entities`) because they grow with the data.
    """
    assigned = assign_splits(block_summary(df), splits)
    blocks = [r.asDict() for r in assigned.orderBy("start_s", C.BLOCK).toLocalIterator()]
    per_split = {r[C.SPLIT]: r.asDict() for r in split_summary(attach_splits(df, assigned)).collect()}
    empty = [name for name in splits.names if name not in per_split]
    if empty and not allow_empty_splits:
        raise TraceError(f"empty splits: {empty}")
    if any(b["start_s"] < a["end_s"] for a, b in zip(blocks, blocks[1:])):
        raise TraceError("blocks overlap")
    labelled = attach_splits(df, assigned)
    return {
        "manifest_version": 1,
        "source_path": source_path,
        "source_fingerprint": source_fingerprint,
        "csv_separator": ";",
        **asdict(rule),
        "boundary_policy": "a block crossing a cut moves to the later split",
        "split_names": list(splits.names),
        "cut_times_s": list(splits.cut_times_s),
        "blocks": blocks,
        "splits": [
            {**per_split[n], "block_ids": [b[C.BLOCK] for b in blocks if b[C.SPLIT] == n]}
            for n in splits.names
            if n in per_split
        ],
        "novelty_reference_splits": list(splits.reference),
        "evaluation_split": splits.evaluation,
        "n_seen_numeric_rntis": seen_entities(labelled, splits).count(),
        "n_unseen_numeric_rntis": unseen_entities(labelled, splits).count(),
        "label_ontology": {name: i for i, name in enumerate(ontology.labels)},
    }
