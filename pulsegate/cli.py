"""``python -m pulsegate.cli STAGE --root DIR [--source TRACE]`` (submit with spark-submit)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pulsegate.config import SplitRule, TraceRule
from pulsegate.plans.stages import STAGES, Workspace, summary_line
from pulsegate.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulsegate", description=__doc__)
    p.add_argument("stage", choices=sorted(STAGES))
    p.add_argument("--root", required=True, help="folder of the stage tables")
    p.add_argument("--source", default="", help="raw trace (';'-separated)")
    p.add_argument("--master", default=None, help="local runs only")
    p.add_argument("--timestamp-scale", type=float, default=TraceRule.timestamp_scale)
    p.add_argument("--gap-seconds", type=float, default=TraceRule.gap_seconds)
    p.add_argument("--max-block-seconds", type=float, default=TraceRule.max_block_seconds)
    p.add_argument("--lease-gap-seconds", type=float, default=TraceRule.lease_gap_seconds)
    p.add_argument("--epoch-seconds", type=float, default=TraceRule.epoch_seconds)
    p.add_argument("--cut", type=float, nargs="*", default=None, help="split cuts, Unix seconds")
    p.add_argument("--replicates", type=int, default=5000)
    p.add_argument("--seed", type=int, default=1729)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    rule = TraceRule(
        args.timestamp_scale, args.gap_seconds, args.max_block_seconds, args.lease_gap_seconds, args.epoch_seconds
    )
    cuts = SplitRule(cut_times_s=tuple(args.cut)) if args.cut else SplitRule()
    spark = build_session(args.master)
    space = Workspace(
        spark, args.root, args.source, rule, cuts, replicates=args.replicates, seed=args.seed
    )
    print(summary_line(args.stage, STAGES[args.stage](space)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
