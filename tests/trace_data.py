"""A small synthetic raw trace with the source schema."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pulsegate.schema import CONSTANT_COLUMNS, KPI_FEATURES, TRACE_COLUMNS, TRACE_ONTOLOGY

START = 1_666_700_100.0  # a multiple of 900 s
HOUR = 3600.0
CUTS = (START + 1.0 * HOUR, START + 1.75 * HOUR, START + 2.5 * HOUR)


def write_trace(path: str, entities: int = 12, hours: float = 3.25, seed: int = 5) -> pd.DataFrame:
    """Entities report about once a second in bursts; attack bursts shift the KPIs."""
    rng = np.random.default_rng(seed)
    frames = []
    for entity in range(entities):
        clock = START + rng.uniform(0, 120)
        while clock < START + hours * HOUR:
            n = int(rng.integers(15, 70))
            t = clock + np.cumsum(rng.uniform(0.6, 1.6, n))
            attack = rng.random() < 0.4
            pool = TRACE_ONTOLOGY.attacks if attack else TRACE_ONTOLOGY.benign
            level = 1.5 if attack else 0.0
            block = {c: np.round(rng.normal(level if i % 3 == 0 else 0.0, 1.0, n), 4) for i, c in enumerate(KPI_FEATURES)}
            block |= {"mac_rnti": np.full(n, 100 + entity), "ue_ident": np.full(n, 100 + entity)}
            block |= {"id_ue": np.full(n, entity), "timestamp": t, "label": np.full(n, str(rng.choice(pool)), dtype=object)}
            block["mob_pattern"] = np.full(n, f"m{entity % 3}", dtype=object)
            frames.append(pd.DataFrame(block))
            clock = t[-1] + rng.uniform(40, 200)
    df = pd.concat(frames, ignore_index=True).sort_values("timestamp", kind="stable")
    df = df[(df["timestamp"] - START) < hours * HOUR]
    df["timestamp"] = np.round(df["timestamp"] * 1e5)
    for name, value in CONSTANT_COLUMNS.items():
        df[name] = value
    df["rf_error"] = rng.integers(0, 3, len(df))
    df = df.reindex(columns=list(TRACE_COLUMNS))
    df.to_csv(path, sep=";", index=False)
    return df
