"""What the text operators share: tables, staged results, words and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.staging import staged

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one Python step holds at a time; longer single texts form a step of their own.
STEP_BYTES = 1 << 20


__all__ = ["STEP_BYTES", "WORD", "arrow_schema", "crc_mod", "map_texts", "slices", "staged", "table", "text_bytes", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts have STEP_BYTES together, or one row where that has more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(docs: DataFrame, columns: list[Column], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow over slices of ``columns`` (texts second). ``make`` runs once a task and gives the
    function from a slice to the output columns, so that caches live as long as the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches):
            out = step(part)
            yield pa.RecordBatch.from_pydict(out, schema=arrow) if not isinstance(out, pa.RecordBatch) else out

    arrow = arrow_schema(schema)
    return docs.select(*columns).mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema for a flat DDL string of the types that these operators return."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def text_bytes(docs: DataFrame, text_col: str) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(docs[text_col], F.lit("")).cast("binary")


def text_key(text_col: str) -> Column:
    """Tells rows of the same id but different text apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
