"""Column helpers built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegate.config import STATE_NAMES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator``, NULL unless the denominator is positive."""
    return F.when(col(denominator) > 0, col(numerator) / col(denominator))


def is_finite(c: Column | str) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def close(a: Column | str, b: Column | str, atol: float) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol)


def sigmoid(score: Column | str) -> Column:
    """Logistic function that never exponentiates a positive number."""
    s = col(score)
    small = F.exp(-F.abs(s))
    return F.when(s >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def logit(p: Column | str, clip: float = 1e-12) -> Column:
    q = F.least(F.greatest(col(p), F.lit(clip)), F.lit(1.0 - clip))
    return F.log(q / (1.0 - q))


def epoch_seconds(ts: Column | str) -> Column:
    """Unix seconds as DOUBLE; naive timestamps are read as UTC whatever the session zone."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), col(ts))
    return micros.cast("double") / F.lit(1e6)


def utc_seconds(text: str) -> Column:
    """Unix seconds of an ISO-8601 literal; a missing offset means UTC."""
    moment = text[:-1] + "+00:00" if text.endswith("Z") else text
    has_zone = "T" in moment and any(sign in moment.split("T", 1)[1] for sign in "+-")
    return F.unix_micros(F.to_timestamp(F.lit(moment if has_zone else moment + "+00:00"))) / F.lit(1e6)


def bin_index(t: Column | str, width: float) -> Column:
    """Index of the fixed-width bin anchored at the Unix epoch."""
    return F.floor(col(t) / F.lit(float(width)))


def slug(c: Column | str) -> Column:
    return F.translate(F.lower(col(c)), "- ", "__")


def colon_key(*parts: Column | str) -> Column:
    """``a:b:c``; NULL when any part is NULL."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(":"), col(part).cast("string")]
    return F.concat(*pieces[1:])


def json_key(*parts: Column) -> Column:
    """Compact JSON array of scalars; pass string parts through :func:`quoted`."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(","), part.cast("string")]
    return F.concat(F.lit("["), *pieces[1:], F.lit("]"))


def quoted(c: Column | str) -> Column:
    escaped = F.regexp_replace(col(c).cast("string"), r'(["\\])', r"\\$1")
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def state_name(code: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, STATE_NAMES)), col(code) + 1)


def state_code(name: Column | str) -> Column:
    """Code of a state name, any case and padding; unknown names raise."""
    clean = F.upper(F.trim(col(name)))
    at = F.array_position(F.array(*map(F.lit, STATE_NAMES)), clean).cast("int") - 1
    return F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown state "), clean)).cast("int"))


def mask_labels(mask: Column | str, labels: Sequence[str], order: Sequence[str] | None = None) -> Column:
    """Labels whose bit is set, in ``order`` (default: ontology order)."""
    chosen = list(order or labels)
    held = [
        F.when(col(mask).bitwiseAND(F.lit(1 << labels.index(name))) != 0, F.lit(name)) for name in chosen
    ]
    return F.filter(F.array(*held), lambda x: x.isNotNull())


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two id arrays; two empty sets are identical."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def total_variation(p: Column | str, q: Column | str) -> Column:
    """Half the L1 distance of two share maps over the union of their keys."""
    keys = F.array_union(F.map_keys(col(p)), F.map_keys(col(q)))

    def step(total: Column, key: Column) -> Column:
        left = F.coalesce(F.element_at(col(p), key), F.lit(0.0))
        right = F.coalesce(F.element_at(col(q), key), F.lit(0.0))
        return total + F.abs(left - right)

    return F.aggregate(keys, F.lit(0.0), step) * 0.5


def canonical_digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by ``;`` — a stable row fingerprint."""
    return F.sha2(F.concat_ws(";", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)
