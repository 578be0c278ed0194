"""Secret scans through an incremental ledger of content-addressed blobs.

Every historical version of every path is a row of text.  A text is addressed by its SHA-256,
so copies, also of other versions and paths, are one blob.  The ledger has one row per blob and
scan: the rules applied, as ``name@version``, and the spans found.  A run scans only pairs of
blob and rule version that the ledger lacks, and appends them; findings are joined back to all
paths by address, without moving a text.  Copies collapse map-side before the one shuffle that
carries texts, and the join back moves addresses only (AQE splits a frequent one).

Edge cases.  A NULL text is an empty blob.  Spans count code points, end exclusive.  Repeated
rows are joined back as often as they came.  An empty ledger, or none, leaves everything unseen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate, sized_broadcast


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, without overlap; matches whose ``group`` is under ``least`` characters fall."""

    name: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Fixed by the contract, in the order of their kinds (letters of keywords in either case).
BASE = (
    Rule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# A private key up to its END line, or, without one before the next five dashes, to the end of its
# base64: header lines, runs of 16 characters or more and the first run of the next line.  Line breaks may be escaped.
_BREAK = r"(?:[\x20\x09-\x0D]|\\[nrt])"
_PEM = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-{1,4}[^-])*-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_BREAK}*[A-Z][A-Za-z]*(?:-[A-Za-z]+)*: [^\r\n\\]*)*(?:{_BREAK}*[A-Za-z0-9+/=]{{16,}})*"
    rf"(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/=]+)?)"
)
_SEGMENT, _REST = r"eyJ[A-Za-z0-9_-]+", r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
# Public token formats, added by this operator.
ADDED = (
    Rule("pem", _PEM, 1, version=2),
    Rule("vcs", r"gh[opsur]_[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", _SEGMENT + _REST, 30),
)
RULES = BASE + ADDED
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def _searchers(rules: Sequence[Rule]):
    """Compiled rules; a long run is searched as such, which gives the same kept matches faster."""
    out = []
    for rule in rules:
        pattern = rule.pattern
        if rule in BASE[1:]:
            # One class repeated: a failing match holds no longer match inside it.
            pattern = pattern[:-1] + "{%d,}" % (rule.least - 4 * (rule.name == "access"))
        if pattern == _SEGMENT + _REST:
            # A first segment that fails is taken whole, as every later start inside it meets the same end:
            # long runs of its prefix cost linear time.  Such a match lacks the group.
            pattern = f"{_SEGMENT}(?P<whole>{_REST})?"
        out.append((rule, re.compile(pattern)))
    return out


def find_spans(text: str | None, rules: Sequence[Rule] = RULES, compiled=None) -> list[tuple[str, int, int]]:
    """Spans as (kind, start, end), by start, then by the order of ``rules``."""
    found = []
    for rank, (rule, pattern) in enumerate(compiled or _searchers(rules)):
        for m in pattern.finditer(text or ""):
            if m.end(rule.group) - m.start(rule.group) >= rule.least and m.groupdict("").get("whole") != "":
                found.append((m.start(), rank, rule.name, m.end()))
    return [(name, a, b) for a, _, name, b in sorted(found)]


def address(text: str = "text") -> Column:
    """Content address of a text; a NULL text is the empty blob."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text"):
    """New ledger rows for the pairs of blob and rule version that ``ledger`` lacks."""
    keys = [r.key for r in rules]
    blobs = (
        versions.select(address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
    )
    wanted = F.array(*[F.lit(k) for k in keys])
    if ledger is None:
        due = blobs.withColumn("due", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        due = blobs.join(seen, "blob", "left").withColumn(
            "due", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        )
    unseen = due.where(F.size("due") > 0)
    by_key = {r.key: r for r in rules}

    def run(texts: list[str], dues: list[list[str]]):
        ready, spans = {}, []
        for t, due in zip(texts, dues):
            chosen = ready.get(tuple(due)) or ready.setdefault(tuple(due), _searchers([by_key[k] for k in due]))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, compiled=chosen)])
        return dues, spans

    return annotate(unseen, ["blob"], [F.col("text"), F.col("due")], run, f"rules array<string>, spans {SPANS}")


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row ``blob, spans`` per blob with findings of the present rule versions, in span order."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    keys = F.array(*[F.lit(r.key) for r in rules])
    names = F.transform(F.array_intersect("rules", keys), lambda k: F.split_part(k, F.lit("@"), F.lit(1)))
    current = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(names, s["kind"])).alias("spans"))
    ordered = F.array_sort(
        F.transform(
            F.array_distinct(F.flatten(F.collect_list("spans"))),
            lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")),
        )
    )
    # A blob has one ledger row per scan, so at most one for each change of the rules.
    found = current.where(F.size("spans") > 0).groupBy("blob").agg(ordered.alias("spans"))
    return found.withColumn(
        "spans", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    )


def by_path(versions: DataFrame, found: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans`` (empty if none) of every version of every path."""
    own = versions.select(*[F.col(f"`{c}`") for c in keep], address(text).alias("__blob"))
    joined = own.join(found.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), "__blob", "left")
    kept = [F.col(f"`{c}`") for c in keep if c != "spans"]
    return joined.select(*kept, F.coalesce("__spans", F.array().cast(SPANS)).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, text: str = "text", bound: int = 20_000) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]``; other texts and all columns stay.

    Overlapping spans are replaced as one.  ``found`` is broadcast up to ``bound`` blobs.
    """
    spans = sized_broadcast(found.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), bound)
    joined = docs.withColumn("__blob", address(text)).join(spans, "__blob", "left")
    body = F.col(f"`{text}`")
    # (text so far, end of the last span): spans come by start.
    state = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["done"], F.substring(body, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("[SECRET]")))
            .otherwise(s["done"])
            .alias("done"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["done"], F.substring(body, (s["at"] + 1).cast("int"), F.length(body))),
    )
    changed = F.col("__spans").isNotNull()
    out = joined.withColumn(text, F.when(changed, state).otherwise(body))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length(body)).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
