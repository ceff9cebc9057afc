"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from citeweave.sources.storage import shared_dir, stored  # noqa: F401

#: A word: a maximal run without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes that a batch may hold, about; a longer row is a batch of its own.
BATCH_BYTES = 8_000_000


def slices(b: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some bytes at most."""
    n = max(1, -(-b.nbytes // most))
    if n == 1:
        yield b
        return
    sizes = np.full(b.num_rows, b.nbytes // b.num_rows)
    if texts := [c for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]:
        sizes = sum(pa.compute.fill_null(pa.compute.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    at = 0
    for cut in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), b.num_rows]:
        if cut > at:
            yield b.slice(at, cut - at)
        at = cut


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str, use: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow with plain lists: fn gets a batch of some BATCH_BYTES at most as {column: values} (of the columns `use`, if given) and returns such a dict."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            if b.num_rows and (got := fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if not use or n in use})) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def replaced(df: DataFrame, fn: Callable[[list], list], text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """df with its texts replaced by fn(texts), and their number of code points in size_col, where there is such a column; other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            k = b.schema.get_field_index(text_col)
            new = pa.array(fn(b.column(k).to_pylist()), pa.string())
            b = b.set_column(k, b.schema.field(k), new)
            n = b.schema.get_field_index(size_col)
            if n >= 0:
                b = b.set_column(n, b.schema.field(n), pa.compute.utf8_length(new).cast(b.schema.field(n).type))
            yield b

    return df.mapInArrow(run, df.schema)


def filtered(df: DataFrame, fn: Callable[[list], list], text_col: str = "text") -> DataFrame:
    """The rows of df whose text fn says yes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            yield b.filter(pa.array(fn(b.column(text_col).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows_of(items: list[tuple], names: list[str]) -> dict[str, list]:
    """Tuples to columns."""
    return dict(zip(names, map(list, zip(*items)), strict=True)) if items else {n: [] for n in names}


def mix64(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; kept and grown as needed."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096, 2 * (len(have[0]) if have else 0))
        up = np.full(size, base & (2**64 - 1), np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > 1 << 22:  # a very long text: don't hold on to its table
            del _POWERS[base]
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    """A 64-bit polynomial hash of each window of n values (uint64, odd base), mixed."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[: len(values) - n + 1])
