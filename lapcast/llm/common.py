"""What the operators of this subpackage share: words, plain columns, let-bindings and batch readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


#: For functions that make of a text many times its length: bytes of a batch's columns that they see at a time, if that is
#: not a single row.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns ``id`` and ``text``; a null text is empty. Other columns, whatever their names, are not read."""
    return df.select(df[key].cast("long").alias("id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array, as they stand."""
    return F.array_remove(F.split(text, SPACE), "")


def words(data: bytes) -> list[bytes]:
    """The words of UTF-8 bytes with A-Z lower-cased: exactly the runs of ``[^\\x20\\x09-\\x0D]``."""
    return data.lower().split()


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes, without decoding."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def spans_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs of the given lengths."""
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 2000, size: int | None = None) -> DataFrame:
    """``mapInArrow`` that sees at most ``rows`` rows at a time, and of long ones about ``size`` bytes, so that a batch of long texts stays small."""

    def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = rows if size is None else max(1, min(rows, size * b.num_rows // max(b.nbytes, 1)))
        return (b.slice(i, step) for i in range(0, b.num_rows, step))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(piece for b in batches for piece in pieces(b))

    return df.mapInArrow(sliced, schema)
