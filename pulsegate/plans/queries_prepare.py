"""Queries: scans, projections, audit, segmentation, epochs, splits, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.functions.ordered import row_index
from pulsegate.functions.scalars import bin_index, colon_key, logit, ratio, sigmoid, slug, state_name
from pulsegate.operators import audit, splits
from pulsegate.operators.epochs import attack_columns, causal_epochs, lease_epochs
from pulsegate.operators.metrics import lease_generation
from pulsegate.operators.segmentation import add_targets, segment_leases, session_table
from pulsegate.plans import sql
from pulsegate.plans.registry import query
from pulsegate.plans.sql import r6, with_recursive
from pulsegate.plans.study import DAILY, SPLITS, Study
from pulsegate.sources.events import EVENT_ONTOLOGY
from pulsegate.sources.tables import table_digest

ATTACKS = "('error', 'purchase')"


@query("scan_reports", f"WITH {sql.REPORTS} SELECT _source_row, mac_rnti, {r6('event_time_s')}, label, id_ue, mob_pattern FROM reports")
def scan_reports(s: Study):
    return s.reports.select(C.ROW, C.SUBJECT, C.TIME, "label", "id_ue", "mob_pattern")


@query("project_score", f"WITH {sql.REPORTS} SELECT _source_row, {r6('risk_score')} FROM reports")
def project_score(s: Study):
    return s.reports.select(C.ROW, C.SCORE)


@query(
    "filter_split",
    f"WITH {sql.blocks()} SELECT _source_row, mac_rnti, trace_block_id FROM blocked WHERE split = 'controller_tune'",
)
def filter_split(s: Study):
    return s.blocked.where(F.col(C.SPLIT) == "controller_tune").select(C.ROW, C.SUBJECT, C.BLOCK)


@query(
    "isin_attack",
    f"""SELECT event_type AS label, event_type IN {ATTACKS} AS is_attack, count(*) AS n_rows,
    {r6('avg(value)', 'mean_value')} FROM events GROUP BY ALL""",
)
def isin_attack(s: Study):
    flag = F.col("label").isin(*EVENT_ONTOLOGY.attacks).alias("is_attack")
    return s.reports.groupBy("label", flag).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean_value"))


@query(
    "map_label_id",
    f"""WITH {sql.REPORTS} SELECT _source_row, CASE label WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2
    WHEN 'error' THEN 3 ELSE 4 END AS label_id, label IN {ATTACKS} AS is_attack FROM reports""",
)
def map_label_id(s: Study):
    return add_targets(s.reports, EVENT_ONTOLOGY).select(C.ROW, "label_id", "is_attack")


@query(
    "scalar_strings",
    """SELECT user_id AS mac_rnti, replace(replace(lower(event_type || '-A b'), '-', '_'), ' ', '_') AS slug,
    user_id || ':' || event_type AS key, sha256(user_id || ':' || event_type) AS digest, count(*) AS n_rows
    FROM events GROUP BY ALL""",
)
def scalar_strings(s: Study):
    rows = s.reports.select(
        C.SUBJECT, slug(F.concat("label", F.lit("-A b"))).alias("slug"), colon_key(C.SUBJECT, "label").alias("key")
    )
    out = rows.withColumn("digest", F.sha2("key", 256))
    return out.groupBy(C.SUBJECT, "slug", "key", "digest").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "scalar_math",
    f"""WITH {sql.REPORTS} SELECT _source_row, floor(event_time_s / 86400.0)::BIGINT AS utc_day_index,
    {r6('1 - exp(-value / 20.0)', 'gain')}, {r6('1 / (1 + exp(-(value - 50) / 25))', 'sigmoid')},
    {r6('ln(greatest(least(risk_score, 1 - 1e-12), 1e-12) / (1 - greatest(least(risk_score, 1 - 1e-12), 1e-12)))', 'logit')},
    {r6('CASE WHEN value > 10 THEN 100.0 / value END', 'guarded')} FROM reports""",
)
def scalar_math(s: Study):
    return s.reports.select(
        C.ROW,
        bin_index(C.TIME, 86400.0).alias("utc_day_index"),
        (-F.expm1(-F.col("value") / 20.0)).alias("gain"),
        sigmoid((F.col("value") - 50) / 25).alias("sigmoid"),
        logit(C.SCORE).alias("logit"),
        F.when(F.col("value") > 10, ratio(F.lit(100.0), "value")).alias("guarded"),
    )


# -- audit ----------------------------------------------------------------------------------


@query(
    "audit_counts",
    f"""WITH {sql.REPORTS} SELECT count(*) AS n_rows, count(*) FILTER (label IS NULL) AS null_label_rows,
    count(*) FILTER (label NOT IN ('click', 'signup', 'view', 'error', 'purchase')) AS unknown_label_rows,
    count(*) FILTER (event_time_s IS NULL) AS timestamp_null_rows,
    count(*) FILTER (NOT isfinite(event_time_s)) AS timestamp_nonfinite_rows,
    count(*) FILTER ((mac_rnti IS NULL) <> (id_ue IS NULL) OR mac_rnti <> id_ue) AS identifier_mismatch_rows,
    count(*) FILTER (value IS NULL OR value <> 1) AS constant__value FROM reports""",
)
def audit_counts(s: Study):
    return audit.column_audit(
        s.reports, C.TIME, "label", EVENT_ONTOLOGY, (C.SUBJECT, "id_ue"), {"value": 1.0}
    )


@query("label_counts", "SELECT event_type AS label, count(*) AS n_rows FROM events GROUP BY 1")
def label_counts(s: Study):
    return audit.label_counts(s.reports)


@query(
    "duplicate_members",
    """SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_members, count(*) AS duplicate_groups FROM (
    SELECT count(*) AS c FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
    HAVING count(*) > 1)""",
)
def duplicate_members(s: Study):
    """Rows that repeat in every column: returned lines delivered once more."""
    lines = s.spark.read.parquet(f"{s.sf_dir}/lineitem.parquet")
    return audit.duplicate_members(lines.unionAll(lines.where("l_returnflag = 'R'")), lines.columns)


@query(
    "time_reversals",
    f"""WITH {sql.REPORTS} SELECT count(*) FILTER (value < prev) AS time_reversals FROM (
    SELECT value, lag(value) OVER (ORDER BY _source_row) AS prev FROM reports)""",
)
def time_reversals(s: Study):
    """Steps back of a column along the source order (``value``, as event time never falls)."""
    return audit.time_reversals(s.reports, "value", chunk_rows=1 << 12)


@query(
    "table_digest",
    """SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 12))::UBIGINT)::HUGEINT::VARCHAR AS sum_high,
    sum(('0x' || substr(h, 13, 12))::UBIGINT)::HUGEINT::VARCHAR AS sum_low
    FROM (SELECT sha256(event_id || ';' || user_id || ';' || event_type) AS h FROM events)""",
)
def digest(s: Study):
    out = table_digest(s.reports, [C.ROW, C.SUBJECT, "label"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("sum_high", "sum_low")})


@query(
    "row_positions",
    f"WITH {sql.REPORTS} SELECT _source_row, row_number() OVER (ORDER BY value, _source_row) - 1 AS position FROM reports",
)
def row_positions(s: Study):
    """Dense position of every report along (value, row id) without a one-task sort."""
    return row_index(s.reports.select(C.ROW, "value"), ["value", C.ROW], "position").select(C.ROW, "position")


# -- segmentation ---------------------------------------------------------------------------


@query("trace_blocks", f"WITH {sql.blocks()} SELECT _source_row, trace_block_id FROM blocked")
def trace_blocks(s: Study):
    return s.blocked.select(C.ROW, C.BLOCK)


@query("leases", f"WITH {sql.leases()} SELECT _source_row, rnti_lease_sequence, rnti_lease_id FROM prepared")
def leases(s: Study):
    return s.prepared.select(C.ROW, C.LEASE_SEQUENCE, C.LEASE)


@query(
    "lease_session_window",
    f"""WITH {sql.REPORTS}, g AS (SELECT *, CASE WHEN event_time_s - lag(event_time_s) OVER w > 43200 THEN 1 ELSE 0 END AS b
      FROM reports WINDOW w AS (PARTITION BY mac_rnti ORDER BY event_time_s)),
    n AS (SELECT *, CAST(sum(b) OVER (PARTITION BY mac_rnti ORDER BY event_time_s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
    SELECT mac_rnti, session, {r6('min(event_time_s)', 'start_s')}, {r6('max(event_time_s)', 'end_s')}, count(*) AS n_reports
    FROM n GROUP BY mac_rnti, session""",
)
def lease_session_window(s: Study):
    """Entity sessions separated by 12 h of silence."""
    return session_table(s.reports, 43200.0)


@query(
    "lease_generation",
    f"""WITH {sql.REPORTS}, c AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM reports
    WINDOW w AS (PARTITION BY mac_rnti ORDER BY event_time_s, _source_row))
    SELECT _source_row, CAST(sum(ch) OVER (PARTITION BY mac_rnti ORDER BY event_time_s, _source_row ROWS UNBOUNDED PRECEDING)
    AS BIGINT) AS lease_generation FROM c""",
)
def generation(s: Study):
    """Changes of a reused lease id (here the label) along each entity's reports."""
    out = lease_generation(s.reports.select(C.ROW, C.SUBJECT, C.TIME, "label"), C.SUBJECT, "label")
    return out.select(C.ROW, "lease_generation")


# -- epochs ---------------------------------------------------------------------------------

EPOCH_COLUMNS = (
    "trace_block_id, rnti_lease_id, mac_rnti, split, samples_in_epoch, is_attack_epoch, mixed_attack_epoch, "
    "array_to_string(labels_in_epoch, ',') AS labels, "
    + ", ".join(
        r6(c)
        for c in ("decision_time_s", "epoch_seconds", "first_event_time_s", "last_event_time_s", "value", "risk_score")
    )
)


def _epoch_view(df):
    labels = F.array_join(C.LABELS, ",").alias("labels")
    numbers = (C.DECISION_TIME, C.DURATION, "first_event_time_s", "last_event_time_s", "value", C.SCORE)
    kept = (C.BLOCK, C.LEASE, C.SUBJECT, C.SPLIT, C.SAMPLES, C.IS_ATTACK, "mixed_attack_epoch")
    return df.select(*kept, labels, *numbers)


@query("causal_epochs", f"WITH {sql.epochs()} SELECT {EPOCH_COLUMNS} FROM epochs")
def epochs(s: Study):
    return _epoch_view(s.epochs)


@query("causal_epochs_daily", f"WITH {sql.epochs(DAILY)} SELECT {EPOCH_COLUMNS} FROM epochs", rule=DAILY)
def epochs_daily(s: Study):
    return _epoch_view(s.epochs)


@query(
    "epoch_contexts",
    f"""WITH {sql.leases()} SELECT rnti_lease_id, floor(event_time_s / 14400.0) * 14400.0 AS epoch_start_s,
    count(*) AS samples_in_epoch, arg_min(id_ue, event_time_s) AS id_ue, count(DISTINCT id_ue) AS id_ue_n_unique,
    arg_min(mob_pattern, event_time_s) AS mob_pattern, count(DISTINCT mob_pattern) AS mob_pattern_n_unique
    FROM prepared GROUP BY 1, 2""",
)
def epoch_contexts(s: Study):
    """Epochs from leased rows with first and distinct context values."""
    out = causal_epochs(s.prepared, s.rule.epoch_seconds, [], ("id_ue", "mob_pattern"), EVENT_ONTOLOGY)
    shown = (C.LEASE, C.EPOCH_START, C.SAMPLES, "id_ue", "id_ue_n_unique", "mob_pattern", "mob_pattern_n_unique")
    return out.select(*shown)


@query(
    "tumbling_window",
    """SELECT user_id AS mac_rnti, floor(epoch_us(ts) / 14400000000)::BIGINT * 14400 + 14400 AS decision_time_s,
    count(*) AS samples_in_epoch FROM events GROUP BY 1, 2""",
)
def tumbling_window(s: Study):
    """Right-edge stamped epochs by Spark's own time window; empty windows stay absent."""
    events = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").select(
        F.col("user_id").alias(C.SUBJECT), F.col("ts").cast("timestamp").alias("at")
    )
    out = events.groupBy(C.SUBJECT, F.window("at", "4 hours")).agg(F.count(F.lit(1)).alias(C.SAMPLES))
    return out.select(C.SUBJECT, F.unix_seconds("window.end").alias(C.DECISION_TIME), C.SAMPLES)


@query(
    "attack_masks",
    f"""WITH {sql.epochs()} SELECT rnti_lease_id, {r6('decision_time_s')}, n_error AS attack_error,
    n_purchase AS attack_purchase, CAST(n_error AS INT) + CAST(n_purchase AS INT) AS attack_types_in_epoch,
    mixed_attack_epoch FROM epochs""",
)
def attack_masks(s: Study):
    out = attack_columns(lease_epochs(s.blocked, s.rule, [], (), EVENT_ONTOLOGY), EVENT_ONTOLOGY)
    masks = ("attack_error", "attack_purchase", "attack_types_in_epoch", "mixed_attack_epoch")
    return out.select(C.LEASE, C.DECISION_TIME, *masks)


@query(
    "label_annotations",
    f"""WITH {sql.epochs()} SELECT rnti_lease_id, {r6('decision_time_s')},
    array_to_string(list_filter(['click', 'signup', 'view', 'error', 'purchase'], lambda x: list_contains(labels_in_epoch, x)), ',')
      AS labels_normalized, label_type_count, CAST(n_error AS INT) + CAST(n_purchase AS INT) AS attack_type_count,
    mixed_label_epoch, CASE WHEN mixed_attack_epoch THEN '__mixed_attack__' WHEN n_error THEN 'error'
      WHEN n_purchase THEN 'purchase' END AS exclusive_attack_type,
    CASE WHEN mixed_attack_epoch THEN 'error|purchase' WHEN n_error THEN 'error' WHEN n_purchase THEN 'purchase' END
      AS attack_type_key FROM epochs""",
)
def label_annotations(s: Study):
    return s.epochs.select(
        C.LEASE,
        C.DECISION_TIME,
        F.array_join("labels_normalized", ",").alias("labels_normalized"),
        "label_type_count",
        "attack_type_count",
        "mixed_label_epoch",
        "exclusive_attack_type",
        "attack_type_key",
    )


# -- splits and entities --------------------------------------------------------------------


@query(
    "block_summary",
    f"""WITH {sql.blocks()} SELECT trace_block_id, {r6('min(event_time_s)', 'start_s')}, {r6('max(event_time_s)', 'end_s')},
    count(*) AS n_rows, count(DISTINCT mac_rnti) AS n_numeric_rntis FROM blocked GROUP BY 1""",
)
def block_summary(s: Study):
    return splits.block_summary(s.blocked)


@query(
    "split_assignment",
    f"WITH {sql.blocks()} SELECT DISTINCT trace_block_id, split FROM blocked",
)
def split_assignment(s: Study):
    return splits.assign_splits(splits.block_summary(s.blocked.drop(C.SPLIT)), SPLITS).select(C.BLOCK, C.SPLIT)


@query("block_split_join", f"WITH {sql.blocks()} SELECT split, label, count(*) AS n_rows FROM blocked GROUP BY ALL")
def block_split_join(s: Study):
    rows = s.blocked.drop(C.SPLIT)
    assigned = splits.assign_splits(splits.block_summary(rows), SPLITS)
    return splits.attach_splits(rows, assigned).groupBy(C.SPLIT, "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "split_summary",
    f"""WITH {sql.blocks()} SELECT split, {r6('min(event_time_s)', 'start_s')}, {r6('max(event_time_s)', 'end_s')},
    count(*) AS n_rows, count(DISTINCT trace_block_id) AS n_blocks, count(DISTINCT mac_rnti) AS n_numeric_rntis,
    array_to_string(list_sort(list(DISTINCT trace_block_id)), ',') AS block_ids FROM blocked GROUP BY 1""",
)
def split_summary(s: Study):
    lists = splits.block_lists(splits.assign_splits(splits.block_summary(s.blocked.drop(C.SPLIT)), SPLITS))
    ids = lists.select(C.SPLIT, F.array_join(F.col("block_ids").cast("array<string>"), ",").alias("block_ids"))
    return splits.split_summary(s.blocked).join(ids, C.SPLIT)


@query(
    "split_prevalence",
    f"""WITH {sql.epochs()} SELECT split, count(*) AS epochs, {r6('avg(is_attack_epoch::INT)', 'prevalence')} FROM epochs GROUP BY 1""",
)
def split_prevalence(s: Study):
    return s.epochs.groupBy(C.SPLIT).agg(
        F.count(F.lit(1)).alias("epochs"), F.avg(F.col(C.IS_ATTACK).cast("int")).alias("prevalence")
    )


_ENTITY = f"""WITH {sql.blocks()}, ref AS (SELECT DISTINCT mac_rnti FROM blocked WHERE split <> 'test'),
ev AS (SELECT DISTINCT mac_rnti FROM blocked WHERE split = 'test')"""


@query("entity_seen_semi", f"{_ENTITY} SELECT mac_rnti FROM ev WHERE mac_rnti IN (SELECT mac_rnti FROM ref)")
def entity_seen_semi(s: Study):
    return splits.seen_entities(s.blocked, SPLITS)


@query("entity_unseen_anti", f"{_ENTITY} SELECT mac_rnti FROM ev WHERE mac_rnti NOT IN (SELECT mac_rnti FROM ref)")
def entity_unseen_anti(s: Study):
    return splits.unseen_entities(s.blocked, SPLITS)


def _customers(s: Study):
    read = s.spark.read.parquet
    buyers = read(f"{s.sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"))
    users = read(f"{s.sf_dir}/events.parquet").select(F.col("user_id").alias("id"))
    return buyers, users


@query("entity_intersect", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def entity_intersect(s: Study):
    buyers, users = _customers(s)
    return buyers.intersect(users)


@query("entity_except", "SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def entity_except(s: Study):
    buyers, users = _customers(s)
    return buyers.subtract(users)


@query("entity_union", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def entity_union(s: Study):
    buyers, users = _customers(s)
    return buyers.unionByName(users).distinct()


@query(
    "union_by_name",
    """SELECT * FROM (SELECT 'block' AS kind, o_orderstatus AS status, count(*) AS n_rows, NULL::VARCHAR AS label FROM orders GROUP BY 2
    UNION ALL SELECT 'event', NULL, count(*), event_type FROM events GROUP BY event_type)""",
)
def union_by_name(s: Study):
    """Union of tables with different columns; what a side lacks is NULL."""
    orders = s.spark.read.parquet(f"{s.sf_dir}/orders.parquet")
    left = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n_rows"))
    right = audit.label_counts(s.reports)
    tagged = (left.withColumn("kind", F.lit("block")), right.withColumn("kind", F.lit("event")))
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


@query(
    "novelty_annotation",
    f"""WITH {sql.epochs()}, ref AS (SELECT DISTINCT mac_rnti FROM epochs WHERE split <> 'test')
    SELECT rnti_lease_id, {r6('decision_time_s')}, CASE WHEN split = 'test' THEN mac_rnti IN (SELECT mac_rnti FROM ref) END
      AS rnti_seen_pretest, CASE WHEN split <> 'test' THEN 'reference' WHEN mac_rnti IN (SELECT mac_rnti FROM ref) THEN 'seen'
      ELSE 'unseen' END AS rnti_novelty FROM epochs""",
)
def novelty_annotation(s: Study):
    return s.novelty.select(C.LEASE, C.DECISION_TIME, C.SEEN, C.NOVELTY)


@query(
    "case_novelty",
    f"""WITH {sql.epochs()}, ref AS (SELECT DISTINCT mac_rnti FROM epochs WHERE split <> 'test')
    SELECT split, CASE WHEN split <> 'test' THEN 'reference' WHEN mac_rnti IN (SELECT mac_rnti FROM ref) THEN 'seen'
      ELSE 'unseen' END AS rnti_novelty, count(*) AS epochs FROM epochs GROUP BY 1, 2""",
)
def case_novelty(s: Study):
    return s.novelty.groupBy(C.SPLIT, C.NOVELTY).agg(F.count(F.lit(1)).alias("epochs"))


@query(
    "state_names",
    f"""WITH {sql.epochs()} SELECT CASE WHEN risk_score >= 0.75 THEN 'ISOLATE' WHEN risk_score >= 0.6 THEN 'RESTRICT'
    ELSE 'ALLOW' END AS state_name, count(*) AS epochs FROM epochs GROUP BY 1""",
)
def state_names(s: Study):
    code = F.when(F.col(C.SCORE) >= 0.75, 2).when(F.col(C.SCORE) >= 0.6, 1).otherwise(0)
    return s.epochs.groupBy(state_name(code).alias("state_name")).agg(F.count(F.lit(1)).alias("epochs"))


@query(
    "segment_rows_direct",
    with_recursive(sql.leases(), "SELECT split, count(DISTINCT rnti_lease_id) AS leases, count(*) AS n_rows FROM prepared GROUP BY 1"),
)
def segment_rows_direct(s: Study):
    out = segment_leases(s.blocked, s.rule.lease_gap_seconds)
    return out.groupBy(C.SPLIT).agg(F.count_distinct(C.LEASE).alias("leases"), F.count(F.lit(1)).alias("n_rows"))
