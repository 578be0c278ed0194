"""One query per operator, over its whole table, with the columns the contracts ask for."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.llm import (
    chat_format,
    decontaminate,
    langid,
    license_match,
    mixing,
    periodic_runs,
    phrases,
    quality,
    secret_ledger,
    simhash,
    site_quality,
    suffix_dedup,
    token_files,
)
from pulsegate.llm.sql import SQL
from pulsegate.session import checkpoint_dir, durable


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of all sources."""
    docs = _read(spark, sf_dir).select(
        "doc_id", "source", mixing.word_count().alias("size"), F.coalesce(F.md5("text"), F.lit("")).alias("content")
    )
    sized = durable(docs)
    schedules = mixing.cycle_schedules(mixing.source_sizes(sized))
    mixed = mixing.mix(sized, schedules)
    taken = F.aggregate("readings", F.lit(0).cast("long"), lambda s, r: s + r["words"])
    first = F.round(F.array_min(F.transform("readings", lambda r: r["position"])), 6)
    rows = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"))
    return mixing.position_order(rows, "first_position")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each document and the verdict of the line rules."""
    return quality.verdict(quality.statistics(_read(spark, sf_dir), ["doc_id"]))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, found once per distinct text."""
    docs = _read(spark, sf_dir)
    found = secret_ledger.findings(secret_ledger.scan_unseen(docs))
    joined = secret_ledger.by_path(docs, found, ["doc_id"])
    base = [r.name for r in secret_ledger.BASE]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return joined.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    rows = durable(simhash.fingerprints(_read(spark, sf_dir), ["doc_id"]))
    return simhash.groups(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without byte strings that also start earlier."""
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document from its text and its site: host = source, path = language section."""
    path = F.concat_ws("/", "source", "lang")
    docs = _read(spark, sf_dir).select("doc_id", F.col("source").alias("host"), path.alias("path"), "text")
    described = durable(site_quality.describe(docs, ["doc_id", "host", "path"]))
    labels = _read(spark, sf_dir, "labels").where(~langid.held_out())
    model = site_quality.fit(described, labels)
    scored = described.withColumn("p", model.probability(F.col("x"))).drop("x")
    return site_quality.score(scored, model)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items met."""
    hits = decontaminate.find_hits(_read(spark, sf_dir), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; a quarter of the ids is held out of training."""
    docs = _read(spark, sf_dir)
    model = langid.fit(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_license_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence that each document or one of its lines carries."""
    out = license_match.match(_read(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat token files."""
    path = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = token_files.write_blocks(_read(spark, sf_dir))
    files.write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    summary = durable(token_files.summarise(written.where("payload IS NOT NULL")))
    order = written.where("ordinal IS NOT NULL").select(
        F.col("file").alias("__file"), "ordinal", F.posexplode("doc_ids").alias("at", "doc_id")
    )
    named = order.select("__file", (F.col("ordinal") + F.col("at")).alias("__ordinal"), "doc_id")
    counted = token_files.stitch(summary)
    same = (counted["file"] == named["__file"]) & (counted["ordinal"] == named["__ordinal"])
    return named.join(counted, same).select("doc_id", "n_tokens")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and trained texts of each conversation, read back from the formatted string."""
    rows = chat_format.gather(_read(spark, sf_dir, "conversations"))
    said = F.lit(chat_format.CONTROL_TEXT)
    control = spark.range(1).select(F.lit(chat_format.CONTROL_CONV).cast("bigint").alias("conv_id"), said.alias("prompt"), said.alias("completion"))
    out = chat_format.format_chats(rows.unionByName(control, allowMissingColumns=True), ["conv_id"])
    read = out.select(
        "conv_id",
        chat_format.parse(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.masked(F.col("formatted"), F.col("loss")), "").alias("trained"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language."""
    return phrases.mine(_read(spark, sf_dir))


def planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words of a document as the contract has them: one in ten repeats a stretch to its end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document, the one of most periods, and the digest of what is left without repeats."""
    found = periodic_runs.find_runs(_read(spark, sf_dir), ["doc_id"], rewrite=planted_period)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def more(best, run):
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.aggregate("runs", none, more)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    listed = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return listed.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


RUNS = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_line_quality,
        op3_secret_ledger,
        op4_simhash_groups,
        op5_repeated_strings,
        op6_site_quality,
        op7_decontaminate,
        op8_language_id,
        op9_license_match,
        op10_token_counts,
        op11_chat_format,
        op12_phrases,
        op13_periodic_runs,
    )
}
