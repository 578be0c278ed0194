"""Column names shared by every stage (the derived-table contract)."""

ROW = "_source_row"
TIME = "event_time_s"
BLOCK = "trace_block_id"
SUBJECT = "mac_rnti"
LEASE_SEQUENCE = "rnti_lease_sequence"
LEASE = "rnti_lease_id"

EPOCH_START = "epoch_start_s"
DECISION_TIME = "decision_time_s"
DURATION = "epoch_seconds"
SAMPLES = "samples_in_epoch"
LABELS = "labels_in_epoch"
IS_ATTACK = "is_attack_epoch"
SCORE = "risk_score"
RAW_SCORE = "risk_raw"

SPLIT = "split"
SEEN = "rnti_seen_pretest"
NOVELTY = "rnti_novelty"
EVALUATION_ROW = "_evaluation_row"

CANDIDATE = "candidate"
FAMILY = "family"

# Names of the synthetic attack streams and of the "all strata" row.
ANY_ATTACK = "__any_attack__"
MIXED_ATTACK = "__mixed_attack__"
ALL_STRATA = "__all__"
