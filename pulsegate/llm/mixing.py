"""Mixing sources to target weights along a time-varying curriculum.

A schedule gives a source's sampling weight over training time t in [0, 1], linear between
knots.  Its integral is the source's weight in the whole mix; targets are those shares of the
total, stopped at ``MAX_EPOCHS`` times the source's size, the excess reshared by weight.  The
cumulative demand of a source, D(t) = target x (integral up to t) / (whole integral), is
inverted in closed form: the reading that begins at word w of the source's stream gets the
position t with D(t) = w.  Documents are range-sorted by position.

The stream of a source is its documents in hash order, pass after pass; the last reading is cut
to the words still wanted, so a source takes its target to within one word.  Prefix sums are
two-level: a window inside hash buckets of bounded size and one over bucket sums, so a source
that holds a third of all rows is spread like any other.

Edge cases.  A NULL source is a source of its own.  Documents without words are never read.
Repeated rows take their turns one after the other; rows that share a doc_id are told apart by
their text.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate.llm.common import WORD

# Fixed by the contract.
WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3

# Shape of the schedules, scaled by the source's weight: the light fade, the heavy rise.
SHAPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SEED = "mix-1"
# Rows that one prefix-sum window should hold on average.
BUCKET_ROWS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """``source, source_size`` with one row per source; ``docs`` has ``source`` and ``size``."""
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"))


def cycle_schedules(sizes: DataFrame, cycle: Sequence[int] = WEIGHT_CYCLE, shapes=SHAPES) -> DataFrame:
    """Add ``schedule`` (knots ``t, w``): sources by code point, NULL last, take weights and shapes in turn.

    One row per source: the window sees the source table only, never documents.
    """
    turn = F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(cycle)))
    knots = F.array(
        *[
            F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w * m)).alias("w")) for t, m in zip((0, 1), shape)])
            for w, shape in zip(cycle, shapes)
        ]
    )
    return sizes.withColumn("schedule", F.element_at(knots, turn + 1))


def integrals(sizes: DataFrame) -> DataFrame:
    """Add ``segments`` (start, width, weights at both ends, integral before) and ``weight``, the whole integral."""
    pairs = F.arrays_zip(
        F.slice("schedule", F.lit(1), F.size("schedule") - 1).alias("p"), F.slice("schedule", F.lit(2), F.size("schedule") - 1).alias("q")
    )
    area = lambda x: (x["q"]["t"] - x["p"]["t"]) * (x["p"]["w"] + x["q"]["w"]) / 2
    empty = F.array().cast("array<struct<t:double,h:double,p:double,q:double,before:double>>")
    walked = F.aggregate(
        pairs,
        F.struct(empty.alias("done"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct(
            F.concat(
                s["done"],
                F.array(
                    F.struct(
                        x["p"]["t"].alias("t"),
                        (x["q"]["t"] - x["p"]["t"]).alias("h"),
                        x["p"]["w"].alias("p"),
                        x["q"]["w"].alias("q"),
                        s["sum"].alias("before"),
                    )
                ),
            ).alias("done"),
            (s["sum"] + area(x)).alias("sum"),
        ),
    )
    return sizes.withColumn("__walk", walked).select(
        *sizes.columns, F.col("__walk.done").alias("segments"), F.col("__walk.sum").alias("weight")
    )


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: shares of all words by ``weight``, stopped at ``max_epochs`` source sizes.

    In order of cap / weight the stopped sources come first, so the level of the others follows
    from prefix sums; the window sees one row per source.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    ranked = sizes.withColumns({"cap": cap, "ratio": cap / F.col("weight")}).withColumns(
        {
            "level": (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
        }
    )
    # The first source whose own cap is above the level of those not stopped before it sets the level.
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    free = F.col("ratio") >= F.col("chosen.ratio")
    target = F.when(F.col("chosen").isNotNull() & free, F.col("weight") * F.col("chosen.level")).otherwise(F.col("cap").cast("double"))
    return ranked.withColumn("chosen", chosen).withColumn("target", target).select(*sizes.columns, "target")


def streams(docs: DataFrame, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``begin``: words of the same source before this document, in hash order.

    ``docs`` has ``doc_id, source, size`` and ``content`` (tells rows with one doc_id apart).
    """
    rows, digits = docs.count(), 1
    while 16**digits * bucket_rows < rows:
        digits += 1
    # MD5 is uniform over ids, so a bucket of hash prefixes is bounded whatever the source's size.
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("content"), F.lit(""))))
    drawn = docs.withColumn("draw", draw).withColumn("bucket", F.substring("draw", 1, digits))
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("draw", "doc_id", "size", "content")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = drawn.withColumn("__local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = local["source"].eqNullSafe(offsets["source"]) & (local["bucket"] == offsets["bucket"])
    return local.join(offsets.withColumnsRenamed({}), same, "left").select(
        *[local[c] for c in docs.columns], (F.col("__local") + F.coalesce("__offset", F.lit(0))).alias("begin")
    )


def position(done: Column, segments: Column, weight: Column) -> Column:
    """Training time at which a share ``done`` of the source's demand is served."""
    wanted = done * weight
    at = F.element_at(F.filter(segments, lambda s: s["before"] <= wanted), -1)
    rest = F.greatest(wanted - at["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(at["p"] * at["p"] + 2 * (at["q"] - at["p"]) / at["h"] * rest, F.lit(0.0)))
    return F.least(at["t"] + F.when(rest > 0, 2 * rest / (at["p"] + root)).otherwise(0.0), F.lit(1.0))


def mix(docs: DataFrame, schedules: DataFrame, seed: str = SEED) -> DataFrame:
    """Every document with its ``readings``: array of (``pass``, ``position``, ``words``), empty if never read.

    ``docs`` has ``doc_id, source, size, content``; ``schedules`` has ``source, source_size, schedule``.
    """
    plan = targets(integrals(schedules)).withColumnRenamed("source", "__source")
    placed = streams(docs, seed)
    # One row per source: AQE broadcasts it when it is small and splits a source that is not.
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["__source"]), "left")
    wanted = F.round("target").cast("long")
    passes = F.when(
        F.col("size") > 0, F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)
    ).otherwise(F.array().cast("array<int>"))
    reading = F.transform(
        passes,
        lambda k: F.struct(
            k.alias("pass"),
            position((k * F.col("source_size") + F.col("begin")) / F.col("target"), F.col("segments"), F.col("weight")).alias("position"),
            F.least(F.col("size"), wanted - k * F.col("source_size") - F.col("begin")).alias("words"),
        ),
    )
    readings = F.when(wanted > 0, F.filter(reading, lambda r: r["words"] > 0)).otherwise(
        F.array().cast("array<struct<pass:int,position:double,words:bigint>>")
    )
    return joined.withColumn("readings", readings).drop("__source", "begin", "schedule", "segments")


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per reading, range-sorted by training position."""
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`") for c in mixed.columns if c != "readings"]
    spread = mixed.select(*columns, F.inline("readings"))
    return spread.repartitionByRange(n, "position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


def position_order(rows: DataFrame, position: str) -> DataFrame:
    """One row per document, range-sorted by its first position; documents that are never read come last."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(position).asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
