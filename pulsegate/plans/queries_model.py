"""Queries: risk model, weights, diagnostics, and the streaming twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import CandidateSpec, TraceRule
from pulsegate.functions.scalars import sigmoid
from pulsegate.operators import boosting, scoring
from pulsegate.operators.boosting import MAX_BINS
from pulsegate.operators.metrics import dwell_weights, effective_sample_size
from pulsegate.plans import sql
from pulsegate.plans.queries_replay import _DWELL
from pulsegate.plans.registry import query
from pulsegate.plans.sql import r6, with_recursive
from pulsegate.plans.study import EPOCH, LOCKED, PROPOSED, RULE, Study
from pulsegate.sources.events import saturating_score
from pulsegate.streaming import online

FEATURES = ("last_value", "score_x2", "samples")
TRAIN = "split = 'train'"


def feature_epochs(s: Study):
    """Epochs with three numeric features; one has gaps to impute."""
    return s.epochs.withColumns(
        {
            "last_value": F.when(F.col("value") <= 150.0, F.col("value")),
            "score_x2": 2.0 * F.col(C.SCORE),
            "samples": F.col(C.SAMPLES).cast("double"),
        }
    )


_FEATURES = f"""{sql.epochs()}, fe AS (SELECT *, CASE WHEN value <= 150 THEN value END AS last_value, 2.0::DOUBLE * risk_score AS score_x2,
    samples_in_epoch::DOUBLE AS samples FROM epochs),
md AS (SELECT median(last_value) AS a, median(score_x2) AS b, median(samples) AS c FROM fe WHERE {TRAIN}),
im AS (SELECT fe.* EXCLUDE (last_value, score_x2, samples), coalesce(last_value, a) AS a, coalesce(score_x2, b) AS b,
    coalesce(samples, c) AS c FROM fe, md),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM im WHERE {TRAIN}),
zs AS (SELECT im.*, (a - ma) / sa AS za, (b - mb) / sb AS zb, (c - mc) / sc AS zc FROM im, st)"""
KEY = f"rnti_lease_id, {r6('decision_time_s')}"


@query(
    "impute_standardise",
    f"WITH {_FEATURES} SELECT {KEY}, {r6('za', 'z_last_value')}, {r6('zb', 'z_score_x2')}, {r6('zc', 'z_samples')} FROM zs",
)
def impute_standardise(s: Study):
    """Exact-median imputation and standardisation fitted on the training split."""
    df = feature_epochs(s)
    prep = scoring.fit_preprocessor(df.where(F.col(C.SPLIT) == "train"), FEATURES, "train")
    shown = [x.alias(f"z_{n}") for n, x in zip(FEATURES, prep.columns())]
    return df.select(C.LEASE, C.DECISION_TIME, *shown)


@query(
    "linear_score",
    f"""WITH {_FEATURES}, sc AS (SELECT *, 0.2 + 0.5 * za - 0.3 * zb + 0.1 * zc AS risk_raw FROM zs)
    SELECT {KEY}, {r6('risk_raw')}, {r6('1 / (1 + exp(-(-0.1 + 1.5 * risk_raw)))', 'risk_score')} FROM sc""",
)
def linear_score(s: Study):
    """Score of a given linear model and calibration: one JVM expression."""
    df = feature_epochs(s)
    prep = scoring.fit_preprocessor(df.where(F.col(C.SPLIT) == "train"), FEATURES, "train")
    model = scoring.RiskModel("logistic", prep, "train", (0.5, -0.3, 0.1), 0.2, calibration=(-0.1, 1.5))
    return scoring.score_frame(model, df.drop(C.SCORE), [C.LEASE, C.DECISION_TIME])


@query(
    "compose_weights",
    f"""WITH {sql.epochs()}, {_DWELL}, t AS (SELECT sum(dwell_weight) AS al, count(*) AS n,
      sum(dwell_weight) FILTER (is_attack_epoch) AS pos, sum(dwell_weight) FILTER (NOT is_attack_epoch) AS neg FROM d)
    SELECT {KEY}, {r6('dwell_weight * n / (2 * CASE WHEN is_attack_epoch THEN pos ELSE neg END)', 'weight')} FROM d, t""",
)
def compose_weights(s: Study):
    out = scoring.compose_weights(s.epochs, dwell=True, balance_classes=True, max_gap=86400.0, name="weight")
    return out.select(C.LEASE, C.DECISION_TIME, "weight")


@query(
    "effective_sample_size",
    f"""WITH {sql.epochs()}, {_DWELL} SELECT count(*) AS rows, {r6('min(dwell_weight)', 'minimum')}, {r6('max(dwell_weight)', 'maximum')},
    {r6('avg(dwell_weight)', 'mean')}, round(sum(dwell_weight) ** 2 / sum(dwell_weight ** 2), 3) + 0.0 AS effective_sample_size FROM d""",
)
def sample_size(s: Study):
    out = effective_sample_size(dwell_weights(s.epochs, max_gap=86400.0), "dwell_weight")
    return out.withColumn("effective_sample_size", F.round("effective_sample_size", 3))


def _fitted(s: Study, kind: str = "logistic", **options):
    df = feature_epochs(s)
    model = scoring.fit_risk_model(df, FEATURES, "train", FEATURES, kind, **options)
    return scoring.fit_platt(model, df), df.drop(C.SCORE)


@query("logistic_score")
def logistic_score(s: Study):
    """Fit on train, calibrate on calibration, score every epoch."""
    model, df = _fitted(s, balance_classes=True, dwell=True, max_gap=86400.0)
    return scoring.score_frame(model, df, [C.LEASE, C.DECISION_TIME, C.SPLIT])


@query("platt_score")
def platt_score(s: Study):
    """Mean calibrated score and prevalence per split."""
    model, df = _fitted(s)
    scored = scoring.score_frame(model, df, [C.SPLIT, C.IS_ATTACK])
    return scored.groupBy(C.SPLIT).agg(
        F.avg(C.SCORE).alias("mean_score"), F.avg(F.col(C.IS_ATTACK).cast("int")).alias("prevalence")
    )


@query("gbt_score")
def gbt_score(s: Study):
    """Shallow tree-ensemble sensitivity model, scored per split."""
    model, df = _fitted(s, "gradient_boosted_trees")
    scored = scoring.score_frame(model, df, [C.SPLIT])
    return scored.groupBy(C.SPLIT).agg(F.count(F.lit(1)).alias("epochs"), F.avg(C.SCORE).alias("mean_score"))


_CUTS = f"""{_FEATURES},
tr AS (SELECT za, zb, zc, is_attack_epoch::INT::DOUBLE AS y FROM zs WHERE {TRAIN}),
vals AS (SELECT 0 AS feature, za AS x, y FROM tr UNION ALL SELECT 1, zb, y FROM tr UNION ALL SELECT 2, zc, y FROM tr),
srt AS (SELECT feature, list(x ORDER BY x) AS xs, count(*) AS n, count(DISTINCT x) AS d FROM vals GROUP BY feature),
dis AS (SELECT feature, list(x ORDER BY x) AS ds FROM (SELECT DISTINCT feature, x FROM vals) GROUP BY feature),
cuts AS (
  SELECT feature, (ds[k] + ds[k + 1]) / 2 AS cut FROM dis JOIN srt USING (feature), range(1, {MAX_BINS}) r(k) WHERE d <= {MAX_BINS} AND k < d
  UNION
  SELECT feature, (xs[1 + (k * (n - 1)) // {MAX_BINS}] + xs[1 + (k * (n - 1) + {MAX_BINS - 1}) // {MAX_BINS}]) / 2
  FROM srt, range(1, {MAX_BINS}) r(k) WHERE d > {MAX_BINS})"""


def _boosting_rows(s: Study):
    train = feature_epochs(s).where(F.col(C.SPLIT) == "train")
    prep = scoring.fit_preprocessor(train, FEATURES, "train")
    return train.withColumns({"y": F.col(C.IS_ATTACK).cast("double"), "w": F.lit(1.0)}), prep.columns()


@query("boosting_bins", f"WITH {_CUTS} SELECT feature, {r6('cut')} FROM cuts")
def boosting_bins(s: Study):
    """Thresholds of the booster's bins: half-way points of few values, quantiles of many."""
    rows, columns = _boosting_rows(s)
    cuts = boosting.bin_thresholds(rows, columns)
    return s.spark.createDataFrame([(i, c) for i, own in enumerate(cuts) for c in own], "feature int, cut double")


@query(
    "boosting_root_splits",
    f"""WITH {_CUTS},
    p AS (SELECT avg(y) AS p, avg(y) * (1 - avg(y)) AS hess FROM tr),
    e AS (SELECT feature, cut, count(*) FILTER (x <= cut) AS nl, sum(p - y) FILTER (x <= cut) AS gl, count(*) AS n, sum(p - y) AS g, any_value(hess) AS hess
          FROM vals JOIN cuts USING (feature), p GROUP BY feature, cut),
    k AS (SELECT *, gl * gl / (nl * hess + 1) + (g - gl) * (g - gl) / ((n - nl) * hess + 1) - g * g / (n * hess + 1) AS gain
          FROM e WHERE nl >= 20 AND n - nl >= 20 AND least(nl, n - nl) * hess >= 0.001)
    SELECT feature, count(*)::BIGINT AS splits, max(nl)::BIGINT AS most_left, round(max(gain), 5) AS best_gain, round(avg(gain), 5) AS mean_gain
    FROM k GROUP BY feature""",
)
def boosting_root_splits(s: Study):
    """Gain of every split of a booster's first node, from one grouped sum of gradients."""
    rows, columns = _boosting_rows(s)
    first = boosting.Boosted(boosting.bin_thresholds(rows, columns), _log_odds(rows))
    binned = boosting.binned(rows, columns, first, F.col("y"), F.col("w"))
    gains = boosting.split_gains(boosting.histogram(binned, (), ((-1, 0, 0, 0.0),), [0], len(columns)))
    return gains.groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits"),
        F.max("n_left").alias("most_left"),
        F.round(F.max("gain"), 5).alias("best_gain"),
        F.round(F.avg("gain"), 5).alias("mean_gain"),
    )


def _log_odds(rows) -> float:
    p = rows.agg(F.avg("y")).first()[0]
    return math.log(p / (1.0 - p))


@query("boosted_score")
def boosted_score(s: Study):
    """Histogram-boosted sensitivity model of all 150 rounds, calibrated and scored per split."""
    model, df = _fitted(s, "hist_gradient_boosting", balance_classes=True)
    scored = scoring.score_frame(model, df, [C.SPLIT])
    return scored.groupBy(C.SPLIT).agg(F.count(F.lit(1)).alias("epochs"), F.avg(C.SCORE).alias("mean_score"))


def _diagnostics_sql(key: str) -> str:
    return f"""WITH {sql.epochs()}, b AS (SELECT {key} AS k, risk_score AS x, is_attack_epoch::INT AS y FROM epochs),
    g AS (SELECT k, x, sum(y) AS p, sum(1 - y) AS q FROM b GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER (PARTITION BY k ORDER BY x DESC) AS cp, sum(q) OVER (PARTITION BY k ORDER BY x DESC) AS cq FROM g),
    m AS (SELECT k, sum(q * (cp - p / 2.0)) / (sum(p) * sum(q)) AS auroc, sum(p * cp / (cp + cq)) / sum(p) AS ap FROM c GROUP BY 1),
    e AS (SELECT k, count(*) AS rows, avg(y) AS prevalence, avg((x - y) * (x - y)) AS brier FROM b GROUP BY 1)
    SELECT rows, {r6('prevalence')}, {r6('brier')}, {r6('auroc::DOUBLE', 'auroc')}, {r6('ap::DOUBLE', 'average_precision')}"""


@query("risk_diagnostics", f"{_diagnostics_sql('0')} FROM m JOIN e USING (k)")
def risk_diagnostics(s: Study):
    return scoring.risk_diagnostics(s.epochs)


@query("risk_diagnostics_by_split", f"{_diagnostics_sql('split')}, k AS split FROM m JOIN e USING (k)")
def risk_diagnostics_by_split(s: Study):
    return scoring.risk_diagnostics(s.epochs, [C.SPLIT])


@query(
    "sigmoid_scores",
    f"WITH {sql.REPORTS} SELECT _source_row, {r6('1 / (1 + exp(-(value - 50) / 10))', 'p')} FROM reports",
)
def sigmoid_scores(s: Study):
    return s.reports.select(C.ROW, sigmoid((F.col("value") - 50) / 10).alias("p"))


# -- streaming ------------------------------------------------------------------------------

# Event time that an entity's reports of the state store are folded by: thirty epochs at most.
STREAM_SLICE_S = 30 * EPOCH
# Leases of a stream are cut by silence of their entity alone: one block holds the whole timeline.
UNCUT = TraceRule(
    gap_seconds=1e10, max_block_seconds=1e10, lease_gap_seconds=RULE.lease_gap_seconds, epoch_seconds=RULE.epoch_seconds
)


def proposed_spec() -> CandidateSpec:
    return next(x for x in LOCKED if x.candidate == PROPOSED)



def _event_stream(s: Study):
    schema = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").schema
    stream = online.read_event_stream(s.spark, s.sf_dir, schema, glob="events.parquet")
    return stream.select(F.col("user_id").alias(C.SUBJECT), F.col("ts").cast("timestamp").alias("at"))


@query(
    "tumbling_stream",
    f"""SELECT user_id AS mac_rnti, (epoch_us(ts) // 14400000000) * 14400 + 14400 AS decision_time_s, count(*) AS samples_in_epoch
    FROM events GROUP BY 1, 2""",
)
def tumbling_stream(s: Study):
    """Windows of the whole stream; those open at its end are closed by its end."""
    return online.run_closed(
        _event_stream(s), lambda events: online.tumbling_epochs(events, "4 hours", "1 hour"), online.stream_folder(s.spark)
    )


@query(
    "session_stream",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000 THEN 1 ELSE 0 END AS b
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id AS mac_rnti, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us, count(*) AS n_reports
    FROM n GROUP BY user_id, sid""",
)
def session_stream(s: Study):
    return online.run_closed(
        _event_stream(s), lambda events: online.session_leases(events, "12 hours", "1 hour"), online.stream_folder(s.spark)
    )


@query(
    "stateful_stream",
    with_recursive(
        sql.trace([x for x in LOCKED if x.candidate == PROPOSED]),
        f"""SELECT mac_rnti, rnti_lease_id, {r6('decision_time_s')}, candidate, previous_state, decision_state AS state,
        {r6('evidence_score')}, pos = 1 AS lifecycle_start FROM trace""",
    ),
)
def stateful_stream(s: Study):
    """The proposed controller over a stream of epochs, state kept per entity.

    The whole table is one trigger; an entity's epochs wait in the state store, slice by slice.
    """
    folder = online.stream_folder(s.spark)
    at = F.timestamp_micros((F.col(C.DECISION_TIME) * 1e6).cast("long")).alias("at")
    inputs = s.epochs.select(C.SUBJECT, C.LEASE, C.DECISION_TIME, C.SCORE, at)
    inputs.write.parquet(f"{folder}/epochs")
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    stream = online.read_event_stream(s.spark, f"{folder}/epochs", inputs.schema, files_per_trigger=10_000)
    return online.run_closed(
        stream, lambda epochs: online.ordered_decisions(epochs, proposed_spec(), STREAM_SLICE_S, "1 hour"), folder
    )


@query(
    "chained_stream",
    with_recursive(
        sql.trace([x for x in LOCKED if x.candidate == PROPOSED], rule=UNCUT),
        f"""SELECT mac_rnti, substr(rnti_lease_id, strpos(rnti_lease_id, ':') + 1) AS rnti_lease_id, {r6('decision_time_s')}, candidate,
        previous_state, decision_state AS state, {r6('evidence_score')}, pos = 1 AS lifecycle_start FROM trace""",
    ),
)
def chained_stream(s: Study):
    """Raw reports to epochs, leases and decisions in one streaming query of two stateful operators."""
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    schema = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").schema
    stream = online.read_event_stream(s.spark, s.sf_dir, schema, glob="events.parquet").select(
        F.col("user_id").alias(C.SUBJECT), F.col("ts").cast("timestamp").alias("at"), saturating_score("value").alias(C.SCORE)
    )
    return online.run_closed(
        stream,
        lambda reports: online.chained_decisions(
            reports, proposed_spec(), "4 hours", UNCUT.lease_gap_seconds, STREAM_SLICE_S, "1 hour"
        ),
        online.stream_folder(s.spark),
    )
