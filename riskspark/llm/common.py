"""What the operators share: reading (id, text), one result per text, the held-out fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Texts handled at a time inside a task; results of so many are in memory.
SLICE = 128


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, so that other columns can have any name; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def per_text(df: DataFrame, make: Callable[[], Callable[[Any], tuple]], columns: str) -> DataFrame:
    """A row (first column, *columns) for each row of a two-column frame.

    ``make`` runs once a task and gives the function from the second column's value to the tuple of ``columns``.
    Needs no shuffle; a lost task is simply run again.
    """
    out = StructType([StructField(df.columns[0], df.schema[0].dataType)] + StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in slices(batches):
            found = list(zip(*[function(x) for x in part.column(1).to_pylist()]))
            arrays = [part.column(0).cast(arrow.field(0).type)]
            arrays += [pa.array(v, type=f.type) for v, f in zip(found, list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
