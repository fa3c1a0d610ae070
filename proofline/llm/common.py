"""Helpers shared by the operators: reading tables, Arrow batches, shared intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from proofline.session import materialise

__all__ = ["ARROW", "annotate", "combine", "mixed", "materialise", "read_table", "runs_of", "text_slices"]

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
         "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, through Spark's own reader, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose text is about ``limit`` bytes at most (one row may be longer)."""
    at = batch.schema.get_field_index(column)
    sizes = np.cumsum([0] + [x or 0 for x in pc.binary_length(batch.column(at)).to_pylist()])
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(sizes, sizes[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers live on, and the next stage's tasks may run in other ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):           # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def annotate(df: DataFrame, text: str, make: Callable[[], Callable], fields: list[tuple[str, str]], *, raw: bool = True,
             keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) followed by ``fields``, computed from a text column batch by batch.

    ``make`` runs once in each task and returns a function from a list of texts (bytes if ``raw``;
    NULL counts as empty) to one list of values per field. No row moves to another task.
    """
    kept = df.columns if keep is None else keep
    made = [StructField(name, _parse_datatype_string(kind), True) for name, kind in fields]
    schema = StructType([df.schema[c] for c in kept] + made)

    def run(batches):
        work = make()
        for whole in batches:
            for batch in text_slices(whole, text):
                column = batch.column(batch.schema.get_field_index(text))
                texts = (column.cast(pa.binary()) if raw else column).to_pylist()
                texts = [t if t is not None else (b"" if raw else "") for t in texts]
                results = work(texts)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array(v, ARROW[kind]) for v, (_, kind) in zip(results, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(name for name, _ in fields)])
                del texts, results, arrays
        del work
        give_back()

    wanted = list(dict.fromkeys([*kept, text]))
    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)


def crc_mod(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that low and high bits depend on every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mixed(left * np.uint64(0xD6E8FEB86659FD93) + mixed(right + np.uint64(0x632BE59BD9B4E019)))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive codes, by doubling: log2(width) passes over the array."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    level, size, done, have = codes, 1, None, 0
    while True:
        if width & size:
            if done is None:
                done, have = level, size
            else:
                n = min(len(done), len(level) - have)
                done, have = combine(done[:n], level[have:have + n]), have + size
        if have == width:
            return done[: len(codes) - width + 1]
        level = combine(level[:-size], level[size:])
        size *= 2


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    level, size = values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    rest = width - size
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(starts, ends, length: int) -> np.ndarray:
    """Which of ``length`` places lie in one of the half-open ranges."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, np.asarray(starts, np.int64), 1)
    np.add.at(step, np.asarray(ends, np.int64), -1)
    return np.cumsum(step[:-1]) > 0


WHITE = re.compile(rb"[\x20\x09-\x0D]+")
