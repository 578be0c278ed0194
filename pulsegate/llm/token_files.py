"""Token counts of flat token files by a separator scan.

A flat token file is a stream of little-endian unsigned integers in which an end-of-document
identifier closes every document; it has no index.  It is read as blocks (``file, block,
payload``) cut without regard to documents or even to whole identifiers.  Each block is searched
for separators in numpy; what it says is narrow: how many it holds, the tokens before its first
one, the lengths between, and the tail after its last.  A prefix scan over the blocks of a file
carries open tails and document numbers across block edges.  The scan is two-level, over chunks of
``CHUNK`` blocks and over chunk sums, so a file of any size is stitched without being one task.

Edge cases.  Empty files have no documents; tokens after the last separator are an open document,
given by :func:`open_tails`.  Two separators in a row close an empty document.  A NULL payload is an
empty block.  A file whose bytes do not make whole identifiers fails.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate.llm.common import annotate
from pulsegate.session import ship_package

# Blocks of 4 MiB: a worker holds one, and its separators, at a time.
BLOCK_BYTES = 1 << 22
CHUNK = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed by the vocabulary file: ranks are 0-50255, 50256 is free and closes documents.
END = 50256
WIDTH = 2


def load_encoder(vocabulary: str = VOCABULARY):
    """Byte-level BPE of a public ranks file; texts are never trained on."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed by the vocabulary: the published pre-tokenisation pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def write_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token files of ``docs`` as blocks, one file per task, and the order of documents in them.

    Rows are either a block (``payload``) or a stretch of the file's ``doc_ids``.  Documents
    end with ``END``; a NULL text is an empty document.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = load_encoder(vocabulary), TaskContext.get().partitionId()
        held, block, ordinal = bytearray(), 0, 0

        def rows(payloads: list[bytes], ids=None):
            nonlocal block
            n, m = len(payloads), 0 if ids is None else 1
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (n + m), pa.int64()),
                    pa.array([*range(block, block + n), *[None] * m], pa.int64()),
                    pa.array([*payloads, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *[ordinal] * m], pa.int64()),
                    pa.array([*[None] * n, *([ids] if m else [])], pa.list_(pa.int64())),
                ],
                names=["file", "block", "payload", "ordinal", "doc_ids"],
            )
            block += n
            return out

        for batch in batches:
            for text in batch.column(1).to_pylist():
                tokens = encoder.encode_ordinary(text) if text else []
                held += np.array([*tokens, END], dtype="<u2").tobytes()
                if len(held) >= block_bytes:
                    cuts = range(0, len(held) - block_bytes + 1, block_bytes)
                    yield rows([bytes(held[c : c + block_bytes]) for c in cuts])
                    del held[: len(cuts) * block_bytes]
            yield rows([], batch.column(0).to_pylist())
            ordinal += batch.num_rows
        if held:
            yield rows([bytes(held)])

    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(run, "file long, block long, payload binary, ordinal long, doc_ids array<long>")


def read_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the raw token files under ``path`` (each below 2 GB, the limit of a binary cell)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    last = F.greatest(F.ceil(F.length("content") / block_bytes) - 1, F.lit(0)).cast("long")
    numbered = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "content")
    return numbered.select(
        "file", "block", F.expr(f"substring(content, cast(block * {block_bytes} + 1 as int), {block_bytes})").alias("payload")
    )


def summarise(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """One narrow row per block: tokens, separators and their places.

    Blocks must hold whole identifiers: keep block sizes a multiple of ``width``.
    """
    kind = np.dtype(f"<u{width}")

    def run(payloads: list[bytes | None]):
        tokens, separators, gaps, heads, tails = [], [], [], [], []
        for p in payloads:
            if len(p or b"") % width:
                raise ValueError(f"a block of {len(p)} bytes does not hold whole identifiers of {width} bytes")
            ids = np.frombuffer(p or b"", dtype=kind)
            at = np.flatnonzero(ids == end)
            tokens.append(len(ids))
            separators.append(len(at))
            heads.append(int(at[0]) if len(at) else None)
            tails.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
            gaps.append((np.diff(at) - 1).tolist())
        return tokens, separators, heads, gaps, tails

    new = "tokens bigint, separators bigint, head bigint, inner array<bigint>, tail bigint"
    return annotate(blocks, ["file", "block"], [F.col("payload")], run, new)


def _prefix(table: DataFrame, order: str) -> DataFrame:
    """Per file along ``order``: separators before, and the tail open since the last separator."""
    before = Window.partitionBy("file", *(["chunk"] if order == "block" else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tokens, seps = F.coalesce(F.sum("tokens").over(before), F.lit(0)), F.coalesce(F.sum("separators").over(before), F.lit(0))
    # Tokens up to and with the last separator seen so far; the rest is open.
    closed = F.max(F.when(F.col("separators") > 0, F.col("upto") - F.col("tail"))).over(before)
    return table.withColumns({"tokens_before": tokens, "separators_before": seps, "closed_before": closed})


def stitch(summary: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Closed documents of every file: ``file, ordinal, n_tokens``."""
    cut = summary.withColumn("chunk", F.floor(F.col("block") / chunk))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    local = _prefix(cut.withColumn("upto", F.sum("tokens").over(inside)), "block")
    sums = local.groupBy("file", "chunk").agg(
        F.sum("tokens").alias("tokens"),
        F.sum("separators").alias("separators"),
        F.max(F.when(F.col("separators") > 0, F.col("upto") - F.col("tail"))).alias("closed"),
    )
    whole = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = _prefix(
        sums.withColumns({"upto": F.sum("tokens").over(whole), "tail": F.col("tokens") - F.coalesce("closed", F.lit(0))}), "chunk"
    ).select(
        "file",
        "chunk",
        F.col("separators_before").alias("__separators"),
        (F.col("tokens_before") - F.coalesce("closed_before", F.lit(0))).alias("__open"),
    )
    joined = local.join(chunks, ["file", "chunk"])
    # Tokens of the document that is open where the block begins.
    opened = F.when(F.col("closed_before").isNotNull(), F.col("tokens_before") - F.col("closed_before")).otherwise(
        F.col("tokens_before") + F.col("__open")
    )
    number = F.col("separators_before") + F.col("__separators")
    lengths = F.when(
        F.col("separators") > 0, F.concat(F.array(opened + F.col("head")), F.col("inner"))
    ).otherwise(F.array().cast("array<bigint>"))
    return joined.select("file", number.alias("__first"), F.posexplode(lengths).alias("__at", "n_tokens")).select(
        "file", (F.col("__first") + F.col("__at")).alias("ordinal"), "n_tokens"
    )


def open_tails(summary: DataFrame) -> DataFrame:
    """``file, n_tokens`` of files that do not end with a separator."""
    ends = summary.groupBy("file").agg(
        F.max(F.when(F.col("separators") > 0, F.struct("block", "tail"))).alias("last"), F.sum("tokens").alias("all")
    )
    after = summary.join(ends.select("file", F.col("last.block").alias("__block")), "file").where(F.col("block") > F.col("__block"))
    more = after.groupBy("file").agg(F.sum("tokens").alias("more"))
    total = F.when(F.col("last").isNull(), F.col("all")).otherwise(F.col("last.tail") + F.coalesce("more", F.lit(0)))
    return ends.join(more, "file", "left").select("file", total.alias("n_tokens")).where("n_tokens > 0")
