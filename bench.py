"""Headline timings: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` select data and cores; prints one JSON line.

``replay_*`` and ``score`` start from input-ready epochs (cached), like the published
single-node numbers; ``e2e_*`` start from Parquet with nothing cached.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pulsegate import columns as C  # noqa: E402
from pulsegate.operators import scoring  # noqa: E402
from pulsegate.operators.controllers import action_trace, replay_inputs  # noqa: E402
from pulsegate.plans.catalogue import QUERIES  # noqa: E402
from pulsegate.plans.queries_model import FEATURES, feature_epochs  # noqa: E402
from pulsegate.plans.study import LOCKED, Study  # noqa: E402
from pulsegate.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
END_TO_END = (
    "trace_blocks",
    "causal_epochs",
    "action_metrics_stateless",
    "action_metrics",
    "epoch_episodes",
    "attack_block_contributions",
    "stateless_references",
    "lease_timeout_sweep",
    "block_adjacency",
    "boot_intervals",
)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_time(run, repeats: int, before=None) -> float:
    took = []
    for attempt in range(repeats + 1):
        if before:
            before()
        started = time.perf_counter()
        run()
        if attempt:
            took.append(time.perf_counter() - started)
    return statistics.median(took)


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        "pulsegate-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in END_TO_END:
        run = QUERIES[name].run
        times[f"e2e_{name}"] = median_time(lambda: sink(run(spark, SF_DIR)), 1, spark.catalog.clearCache)

    spark.catalog.clearCache()
    epochs = replay_inputs(Study(spark, SF_DIR).epochs).repartition(C.BLOCK, C.SUBJECT).persist()
    rows = epochs.count()
    for spec in LOCKED:
        times[f"replay_{spec.family}"] = median_time(
            lambda: sink(action_trace(epochs, [spec], order=[C.DECISION_TIME])), REPEATS
        )
    times["replay_all_five"] = median_time(lambda: sink(action_trace(epochs, LOCKED, order=[C.DECISION_TIME])), REPEATS)

    # Ten times the epochs (leases renamed): what is left when fixed job costs are spread.
    copies = F.explode(F.array(*map(F.lit, range(10))))
    large = epochs.withColumn("copy", copies).withColumn(C.LEASE, F.concat(C.LEASE, F.lit("/"), F.col("copy").cast("string")))
    large = large.drop("copy").repartition(C.BLOCK, C.SUBJECT).persist()
    large.count()
    times["replay_all_five_x10"] = median_time(lambda: sink(action_trace(large, LOCKED, order=[C.DECISION_TIME])), REPEATS)
    large.unpersist()

    features = feature_epochs(Study(spark, SF_DIR)).select(C.SPLIT, C.IS_ATTACK, *FEATURES).persist()
    features.count()
    prep = scoring.fit_preprocessor(features, FEATURES, "train")
    model = scoring.RiskModel("logistic", prep, "train", (0.5, -0.3, 0.1), 0.2, calibration=(-0.1, 1.5))
    times["score"] = median_time(lambda: sink(scoring.score_frame(model, features)), REPEATS)

    rates = {k: round(rows / t) for k, t in times.items() if k.startswith(("replay_", "score"))}
    rates["replay_all_five"] *= len(LOCKED)
    rates["replay_all_five_x10"] *= 10 * len(LOCKED)
    print(
        json.dumps(
            {
                "metric": "total headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 4) for k, v in times.items()},
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "epochs": rows,
                "epochs_per_second": rates,
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
