"""Pieces the training-data operators share: words, Arrow row maps, shared tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import materialize, release  # noqa: F401

#: Bytes that are part of a word are kept, A-Z become a-z, all others become a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Rows in an Arrow batch.
BATCH_ROWS = 1024


def words_of(data: bytes) -> list[bytes]:
    """The words ``[0-9a-z\\x80-\\xff]+`` of a UTF-8 text after lower-casing A-Z only."""
    return data.translate(WORD_BYTES).split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_counted(table: DataFrame, own: DataFrame, key: str, rows: int, hot_keys: int = 1000) -> DataFrame:
    """``table``, of ``rows`` rows, joined with ``own``, which has a row for each key and in ``__n`` how
    many rows of the table have it. Keys of more than ``rows / hot_keys`` rows, fewer than
    ``hot_keys`` by that, are broadcast, so that no task gathers the rows of one."""
    least = max(100_000, rows // hot_keys)
    hot, cold = own.filter(F.col("__n") > least).drop("__n"), own.filter(F.col("__n") <= least).drop("__n")
    rest = table.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(cold, key).unionByName(table.join(F.broadcast(hot), key))


def _trim() -> None:
    """Give freed memory back to the system, where its C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` over batches of at most ``BATCH_ROWS`` rows: Spark's default of 10,000
    whole texts a batch, once in the JVM and again in Python, is too much for a small executor."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))

    def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # the worker lives on
        _trim()

    return df.mapInArrow(freed, schema)


def map_batches(
    df: DataFrame, added: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: list[str] | None = None
) -> DataFrame:
    """Run ``make()`` once a task; what it returns gives the ``added`` columns of each Arrow batch.

    The columns in ``keep`` (default: all) pass through untouched, in front of the new ones.
    """
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + added)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            new = fn(batch)
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip([*old, *new], arrow, strict=True)], schema=arrow)

    return map_arrow(df, run, schema)


def per_text(fn: Callable[[bytes], tuple], kinds: list[pa.DataType], text_col: str) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    """An Arrow batch function from one on a single text, which returns a value for each kind."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[list] = [[] for _ in kinds]
        for text in as_bytes(batch.column(batch.schema.get_field_index(text_col))):
            for column, value in zip(out, fn(text), strict=True):
                column.append(value)
        return [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]

    return run
