"""Licence scans: normalised text against licence templates by Dice over word bigrams.

DataFrame functions only.  A document is compared by its whole text and by each of its lines
(a licence is mostly a line, a header or the whole file), and, unless it matches as a whole, by every
run of words as long as a template: wrapped notices, licence sentences inside paragraphs and full texts
inside longer documents are such runs.  A line that matches is one word of its own kind to the runs.
Dice >= t needs t / (2 - t) x |template| <= |candidate| <= (2 - t) / t x |template| bigrams, so candidates
outside every template's bounds are never looked at, and only templates within bounds meet a candidate.
A run needs t / (2 - t) of a template's bigrams, so only runs that span that many hits are scored; hits are
bigrams whose 64-bit hash is one of a template's.

Runs of one place count as one match.  A place inside that of a template with ``PART`` times its bigrams or more
is a part of it, as the notice in the appendix of a full text is, though its own score may be higher: full texts
rarely match to the last word.

Templates are parameters of a fixed size and travel as literals, so nothing is shuffled or joined.  Texts go on
only with one of the :func:`anchors` of the short templates, or with as many bigrams of the long ones as the least
match of one holds; ``LONG`` tells which of these two exact tests stands for a template, and alters no result.

Edge cases.  NULL, empty and wordless texts match nothing.  A candidate of one word has no bigrams.
Very long texts are scanned whole; the work follows their words and hits.  Equal scores go to the template that
sorts first.  Repeated rows are each given back, an empty table gives an empty one.  Extra columns stay;
``license``, ``dice`` and ``n_matches`` are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.license_templates import TEMPLATES

THRESHOLD = 0.8
# Templates of more bigrams are foreseen by counting their bigrams, others by their anchors.
LONG = 400
PART = 2
# Frequent in prose: their letters make no bigram telling.
_COMMON = frozenset("a an and any are as be by for from in is it may no not of on or other such that the this to under with without work you".split())


def normal_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-/:-`{-\x7F]+"), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words, space-joined."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(pairs)


def normal_template(text: str) -> list[str]:
    return re.sub(r"[\x00-/:-`{-\x7f]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = normal_template(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(templates: Mapping[str, str], threshold: float) -> set[str]:
    """Bigrams of which every match holds at least one.

    A match holds t / (2 - t) of a template's bigrams or more, so one bigram more than the rest of them
    cannot all be absent; those of long and infrequent words are taken, as they are rare in prose.
    """
    out: set[str] = set()
    for text in templates.values():
        pairs = template_bigrams(text)
        rank = {p: (sum(len(w) for w in p.split(" ") if w not in _COMMON), p) for p in pairs}
        out |= set(sorted(pairs, key=rank.__getitem__, reverse=True)[: len(pairs) - _need(len(pairs), threshold) + 1])
    return out


def _need(grams: int, threshold: float) -> int:
    """Fewest of ``grams`` bigrams that a match holds."""
    return math.ceil(threshold / (2 - threshold) * grams - 1e-9)


_SCORES = "array<struct<minus:double,name:string>>"
_PLACES = "array<struct<start:int,end:int,minus:double,name:string,grams:int>>"


def _literal(pairs: list[str]) -> Column:
    """Bigrams as one literal, which is folded to an array; words hold no bar."""
    return F.split(F.lit("|".join(pairs)), r"\|")


def _judge(text: Column, own: Mapping[str, list[str]], threshold: float) -> Column:
    """Best template of a text as an array of one struct ``minus, name``, empty below the threshold."""
    # Rounding must not shut out a candidate at its very bound.
    reach = (2 - threshold) / threshold + 1e-9
    low, high = min(map(len, own.values())) / reach, max(map(len, own.values())) * reach

    def scores(b: Column) -> Column:
        each = []
        for name, pairs in own.items():
            near = (F.size(b) * reach >= len(pairs)) & (F.size(b) <= len(pairs) * reach)
            dice = F.when(near, 2.0 * F.size(F.array_intersect(b, _literal(pairs))) / (F.size(b) + len(pairs))).otherwise(0.0)
            each.append(F.struct((-dice).alias("minus"), F.lit(name).alias("name")))
        return F.array_min(F.array(*each))

    words = F.filter(F.transform(F.array(text), normal_words), lambda w: (F.size(w) > low) & (F.size(w) > 1))
    # Distinct bigrams number words - 1 at most; their bound is applied per template above.
    found = F.filter(F.transform(words, bigrams), lambda b: (F.size(b) >= low) & (F.size(b) <= high))
    return F.filter(F.transform(found, scores), lambda s: s["minus"] <= -threshold)


def _key(bigram: str) -> int:
    """What ``xxhash64(first, second)`` gives for a bigram."""
    first, second = bigram.split(" ")
    h = xxhash.xxh64_intdigest(second.encode(), xxhash.xxh64_intdigest(first.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def _keys(bigrams: Iterable[str]) -> str:
    return ", ".join(f"{k}L" for k in sorted(map(_key, bigrams)))


def _pair_keys(words: Column) -> Column:
    """64-bit hashes of the pairs of neighbours of ``words``."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count), lambda a, b: F.xxhash64(a, b))


def _run_places(name: str, pairs: list[str], length: int, threshold: float) -> Column:
    """Places of runs of ``length`` words that match a template, from ``__hits`` (place, key) and ``__keys``.

    The hits k .. k + need - 1 lie in one run if they span no more than its bigrams.  Starts of a run over
    such hits begin behind those of the hits before, so that no start is met twice.
    """
    need = _need(len(pairs), threshold)
    known, lead, total = _keys(pairs), length - 2, len(pairs)
    inside = f"transform(filter(__hits, x -> x.k IN ({known})), x -> x.p)"
    first = f"greatest(0, get(h, k + {need - 1}) - {lead}, coalesce(get(h, k - 1) + 1, 0))"
    last = f"least(a, size(__keys) + 1 - {length})"
    starts = f"flatten(transform(h, (a, k) -> CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE array() END))"
    run = f"slice(__keys, i + 1, {length - 1})"
    dice = (
        f"transform(array(size(array_distinct({run}))), d -> -2.0D * size(array_intersect({run}, array({known}))) / (d + {total}))[0]"
    )
    scored = f"filter(transform({starts}, i -> struct(i AS start, {dice} AS minus)), s -> s.minus <= {-threshold!r}D)"
    # Starts rise; runs that overlap are one place with the best of their scores.
    joined = (
        f"aggregate({scored}, cast(array() AS array<struct<start:int,end:int,minus:double>>), (done, s) ->"
        f" CASE WHEN size(done) > 0 AND s.start < element_at(done, -1).end THEN concat(slice(done, 1, size(done) - 1), array(struct("
        f"element_at(done, -1).start AS start, s.start + {length} AS end, least(element_at(done, -1).minus, s.minus) AS minus)))"
        f" ELSE concat(done, array(struct(s.start AS start, s.start + {length} AS end, s.minus AS minus))) END)"
    )
    named = f"transform({joined}, s -> struct(s.start AS start, s.end AS end, s.minus AS minus, '{name}' AS name, {total} AS grams))"
    each = f"flatten(transform(filter(array({inside}), h -> size(h) >= {need}), h -> {named}))"
    return F.expr(f"cast({each} AS {_PLACES})")


def match(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` plus ``license`` (best template or NULL), ``dice`` (NULL likewise) and ``n_matches`` (places that match).

    Columns of these names in ``docs`` are replaced.  No shuffle: each row is judged where it lies.
    """
    own = {name: template_bigrams(t) for name, t in sorted(templates.items())}
    own = {name: b for name, b in own.items() if b}
    short = {name: templates[name] for name, b in own.items() if len(b) <= LONG}
    long_ = {name: b for name, b in own.items() if len(b) > LONG}
    body, none = F.col(f"`{text}`"), F.array().cast(_SCORES)
    kept = [c for c in docs.columns if c not in ("license", "dice", "n_matches")]
    every = _keys({b for pairs in own.values() for b in pairs})
    out = docs.withColumn("__some", F.expr("cast(array() AS array<bigint>)"))
    if own:
        pairs = _pair_keys(normal_words(F.coalesce(body, F.lit(""))))
        out = docs.withColumn("__keys", pairs).withColumn("__some", F.expr(f"filter(__keys, k -> k IN ({every}))"))
    tests = []
    if short:
        tests.append(f"exists(__some, k -> k IN ({_keys(anchors(short, threshold))}))")
    if long_:
        least = _need(min(map(len, long_.values())), threshold)
        union = _keys({b for pairs in long_.values() for b in pairs})
        tests.append(f"(size(__some) >= {least} AND size(array_distinct(filter(__some, k -> k IN ({union})))) >= {least})")
    out = out.withColumn("__near", F.expr(" OR ".join(tests) or "false"))
    out = out.withColumn("__parts", F.when(F.col("__near"), F.split(body, "\n")).otherwise(F.array().cast("array<string>")))
    judged = lambda c: _judge(c, own, threshold)
    out = out.withColumn("__lines", F.when(F.size("__parts") > 1, F.transform("__parts", judged)).otherwise(F.transform("__parts", lambda _: none)))
    out = out.withColumn("__body", F.when(F.col("__near"), _judge(body, own, threshold)).otherwise(none))
    words = lambda c, j: F.when(F.size(j) > 0, F.array(F.lit("\n"))).otherwise(normal_words(c))
    open_ = F.col("__near") & (F.size("__body") == 0)
    no_words = F.array().cast("array<string>")
    out = out.withColumn("__words", F.when(open_, F.flatten(F.zip_with("__parts", "__lines", words))).otherwise(no_words))
    out = out.withColumn("__keys", _pair_keys(F.col("__words")))
    hits = f"filter(transform(__keys, (k, p) -> struct(p, k)), x -> x.k IN ({every}))" if own else "array()"
    out = out.withColumn("__hits", F.expr(f"cast({hits} AS array<struct<p:int,k:bigint>>)"))
    runs = [_run_places(n, b, len(normal_template(templates[n])), threshold) for n, b in own.items()]
    found = F.flatten(F.array(*runs)) if runs else F.array().cast(_PLACES)
    out = out.withColumn("__runs", F.when(F.size("__hits") > 0, found).otherwise(F.array().cast(_PLACES)))
    # Lines that match are places of one word.
    sizes = F.create_map(*[F.lit(x) for n, b in own.items() for x in (n, len(b))]) if own else F.lit(None).cast("map<string,int>")
    marks = F.filter(F.transform("__words", lambda w, p: F.when(w == "\n", p)), lambda p: p.isNotNull())
    line_places = F.zip_with(
        marks,
        F.flatten("__lines"),
        lambda p, s: F.struct(
            p.alias("start"), (p + 1).alias("end"), s["minus"].alias("minus"), s["name"].alias("name"), sizes[s["name"]].alias("grams")
        ),
    )
    out = out.withColumn("__all", F.when(F.size("__words") > 0, F.concat("__runs", line_places.cast(_PLACES))).otherwise(F.array().cast(_PLACES)))
    whole = lambda x: ~F.exists(
        F.col("__all"), lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["grams"] >= PART * x["grams"])
    )
    out = out.withColumn("__places", F.array_sort(F.filter("__all", whole)))
    # Places that overlap are one match.
    n_places = F.aggregate(
        "__places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + (x["start"] >= s["end"]).cast("int")).alias("n"), F.greatest(s["end"], x["end"]).alias("end")),
        lambda s: s["n"],
    )
    direct = F.concat(F.flatten("__lines"), "__body")
    in_places = F.transform("__places", lambda x: F.struct(x["minus"].alias("minus"), x["name"].alias("name")))
    closed = F.size("__body") > 0
    out = out.withColumn("__matched", F.when(closed, direct).otherwise(in_places))
    out = out.withColumn("__n", F.when(closed, F.size(direct)).otherwise(n_places))
    best = F.array_min("__matched")
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        best["name"].alias("license"),
        (-best["minus"]).alias("dice"),
        F.col("__n").cast("long").alias("n_matches"),
    )
