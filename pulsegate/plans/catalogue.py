"""All registered queries."""

from pulsegate.plans import (  # noqa: F401
    queries_infer,
    queries_model,
    queries_prepare,
    queries_replay,
    queries_select,
    queries_sensitivity,
)
from pulsegate.plans.registry import QUERIES

__all__ = ["QUERIES"]
