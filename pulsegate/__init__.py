"""Spark-native analytics for entity event streams.

The package turns raw per-entity reports into trace blocks, leases and causal
epochs, replays stateful access controllers over them, and computes
time-weighted, episode and block-additive metrics, policy selection and paired
cluster-bootstrap inference.  Every stage takes and returns a ``DataFrame``.
"""

__version__ = "0.1.0"
