"""Helpers shared by the operators: byte-level words, row keys, sized broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegate.session import ship_package

# Fixed by the contracts: words are runs of anything but space and \t-\r.
WORD = r"[^\x20\x09-\x0D]+"

SLICE = 1024


def raw(text: str = "text") -> Column:
    """UTF-8 bytes of a text column, so that Python tasks neither decode nor encode again."""
    return F.col(text).cast("binary")


def split_words(data: bytes | None) -> list[bytes]:
    """Words of ``WORD`` as bytes: ``bytes.split`` separates at exactly space and \\t-\\r."""
    return data.split() if data else []


def annotate(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    fn: Callable[..., Sequence[Sequence]],
    new: str,
) -> DataFrame:
    """``keep`` columns of ``df`` plus the columns ``new`` (DDL), computed per Arrow batch.

    ``fn`` gets one Python list per input and returns one sequence per new column.  Kept
    columns pass through as Arrow data, so NULL integers stay integers; those that clash
    with a new name are dropped.  Spark bounds a batch by rows and by bytes.
    """
    ship_package(df.sparkSession)
    added = T.StructType.fromDDL(new)
    kept = [c for c in dict.fromkeys(keep) if c not in added.names]
    source = df.select(
        *[F.col(f"`{c}`") for c in kept], *[c.alias(f"__input_{i}") for i, c in enumerate(inputs)]
    )
    schema = T.StructType([*source.schema.fields[: len(kept)], *added.fields])
    types, n = [f.type for f in to_arrow_schema(added)], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Slices keep the Python objects of a batch few at a time.
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = fn(*[batch.column(i).to_pylist() for i in range(n, batch.num_columns)])
                columns = [pa.array(values, t) for values, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def sized_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """Hint ``df`` as broadcast when it has at most ``bound`` rows; else leave the join to AQE.

    ``bound`` plus one rows are counted at most.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
