"""Schema of the raw trace and the label ontology."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

CSV_SEPARATOR = ";"

# Exact names and order of the source export.
TRACE_COLUMNS = (
    "mac_rnti mac_dl_cqi mac_dl_mcs mac_dl_brate mac_dl_ok mac_dl_nok phy_ul_pusch_sinr phy_ul_pucch_sinr phy_ul_mcs "
    "mac_ul_brate mac_ul_ok mac_ul_nok mac_ul_bsr mac_pci mac_nof_tti mac_cc_idx mac_dl_buffer mac_dl_ri mac_dl_pmi mac_phr "
    "mac_dl_cqi_offset mac_ul_snr_offset mac_ul_rssi mac_fec_iters mac_dl_mcs_samples mac_ul_mcs mac_ul_mcs_samples phy_ul_n "
    "phy_ul_pusch_rssi phy_ul_pusch_tpc phy_ul_pucch_rssi phy_ul_pucch_ni phy_ul_turbo_iters phy_ul_n_samples phy_ul_n_samples_pucch "
    "phy_dl_mcs phy_dl_pucch_tpc phy_dl_n_samples rf_o rf_u rf_l rf_error label ue_ident "
    "timestamp id_ue mob_pattern"
).split()

# Columns with one constant value in a sound export.
CONSTANT_COLUMNS = {"mac_pci": 1.0} | dict.fromkeys(
    (
        "mac_cc_idx mac_dl_ri mac_dl_pmi mac_ul_rssi mac_fec_iters mac_dl_mcs_samples mac_ul_mcs mac_ul_mcs_samples "
        "phy_ul_n phy_ul_pusch_tpc phy_dl_pucch_tpc rf_o rf_u rf_l"
    ).split(),
    0.0,
)

IDENTIFIERS = ("mac_rnti", "ue_ident", "id_ue")
TARGETS = ("label", "label_id", "is_attack")
CONTEXTS = ("id_ue", "mob_pattern")

# Model features and names a model may never see.
KPI_FEATURES = (
    "mac_dl_cqi mac_dl_mcs mac_dl_brate mac_dl_ok mac_dl_nok phy_ul_pusch_sinr phy_ul_pucch_sinr phy_ul_mcs mac_ul_brate "
    "mac_ul_ok mac_ul_nok mac_ul_bsr mac_nof_tti mac_dl_buffer mac_phr mac_dl_cqi_offset mac_ul_snr_offset phy_ul_pusch_rssi "
    "phy_ul_pucch_rssi phy_ul_pucch_ni phy_ul_turbo_iters phy_ul_n_samples phy_ul_n_samples_pucch phy_dl_mcs phy_dl_n_samples "
    "samples_in_epoch"
).split()
FORBIDDEN_FEATURES = frozenset(
    (
        "mac_rnti ue_ident id_ue timestamp event_time_s decision_time_s epoch_start_s first_event_time_s last_event_time_s "
        "trace_block_id rnti_lease_sequence rnti_lease_id mob_pattern mobility label label_id is_attack is_attack_epoch "
        "labels_in_epoch target_observed partition split _source_row rf_error mac_pci mac_cc_idx"
    ).split()
)
FORBIDDEN_FEATURE_PATTERN = re.compile(
    r"(?:^|_)(?:rnti|ue_ident|id_ue|imsi|imei|subscriber|device_id|timestamp|event_time|decision_time|epoch_start|"
    r"mob_pattern|mobility|label|target|attack|trace_block|lease_id|partition|split|source_row)(?:_|$)",
    re.IGNORECASE,
)


class TraceError(ValueError):
    """A table breaks the contract of the stage that reads it."""


@dataclass(frozen=True)
class Ontology:
    """Ordered label vocabulary; a label's position is its id and its bit in a mask."""

    benign: tuple[str, ...]
    attacks: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(set(self.labels)) != len(self.labels):
            raise ValueError("labels must be unique")
        if len(self.labels) > 30:
            raise ValueError("an ontology holds at most 30 labels")

    @property
    def labels(self) -> tuple[str, ...]:
        return self.benign + self.attacks

    @property
    def attack_mask(self) -> int:
        return sum(1 << self.labels.index(a) for a in self.attacks)

    @staticmethod
    def slug(label: str) -> str:
        return label.casefold().replace("-", "_").replace(" ", "_")


# The source export's label ontology (ids 0-7).
TRACE_ONTOLOGY = Ontology(
    benign=("Web Browsing", "SIPP", "youtube", "iot"),
    attacks=("portscan", "ddos-ripper-C", "dos-hulk-C", "slowloris-C"),
)


def trace_schema(columns: Sequence[str] = TRACE_COLUMNS) -> T.StructType:
    """Explicit read schema: three LONG identifiers, two STRINGs, the rest DOUBLE."""
    kinds = dict.fromkeys(IDENTIFIERS, T.LongType()) | dict.fromkeys(("label", "mob_pattern"), T.StringType())
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])
