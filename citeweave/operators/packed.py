"""A join of two tables with a row for each citation, whose rows cross the exchange in packed columns.

Rows with texts that repeat take 20 to 45 bytes each in Spark's shuffle files; the same rows by column, compressed, take
a fraction. A part of the keys has to fit a task's memory on the right side; the left one passes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes of rows that a task holds until it packs them.
HELD = 64_000_000


def _packed(df: DataFrame, key: str, parts: int, side: int) -> DataFrame:
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        to = t.column("_to").to_numpy()
        t = t.drop_columns(["_to"]).take(np.argsort(to, kind="stable")).combine_chunks()
        size = np.bincount(to, minlength=parts)
        blobs = []
        for start, n in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
            if n:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t.slice(start, n))
                blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(size), pa.int32()), pa.array([side] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["_to", "side", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= HELD:
                yield pack(held)
                held = []
        if sum(x.num_rows for x in held):
            yield pack(held)

    return df.withColumn("_to", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).mapInArrow(run, "_to int, side int, rows binary")


def met(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left.join(right, key, how) for "left" and "inner". Packed where the key is a long on both sides. Select the columns first: none is pruned later."""
    if not all(isinstance(df.schema[key].dataType, LongType) for df in (left, right)):
        return left.join(right, key, how)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [c for c in right.columns if c != key]
    schema = StructType([StructField(f.name, f.dataType) for f in (*left.schema, *[right.schema[c] for c in more])])
    shape, none = to_arrow_schema(schema), to_arrow_schema(right.schema).empty_table()

    def looked_up(rows: list[pa.Table]) -> tuple[np.ndarray, pa.Table]:
        t = pa.concat_tables(rows) if rows else none
        t = t.filter(pa.compute.is_valid(t.column(key))).sort_by(key).combine_chunks()
        return t.column(key).to_numpy(), t

    def joined(rows: pa.Table, keys: np.ndarray, found: pa.Table) -> pa.Table:
        k = pa.compute.fill_null(rows.column(key), 0).to_numpy()
        first = np.searchsorted(keys, k)
        n = np.where(pa.compute.is_valid(rows.column(key)).to_numpy(), np.searchsorted(keys, k, "right") - first, 0)
        times = np.maximum(n, 1) if how == "left" else n
        at = np.repeat(np.arange(len(k)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        beside = found.take(pa.array(first[at] + nth, mask=n[at] == 0))
        out = rows if len(at) == len(k) and (times == 1).all() else rows.take(at)
        return pa.table([*out.columns, *[beside.column(c) for c in more]], names=[*rows.column_names, *more]).select(shape.names).cast(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, have = None, [], None
        for b in batches:
            for to, side, blob in zip(*(b.column(c) for c in ("_to", "side", "rows")), strict=True):
                if to.as_py() != part:
                    part, held, have = to.as_py(), [], None
                rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
                if side.as_py() == 0:
                    held.append(rows)
                    continue
                have = have or looked_up(held)
                yield from joined(rows, *have).combine_chunks().to_batches(max_chunksize=20_000)

    both = _packed(right.select(key, *more), key, parts, 0).unionByName(_packed(left, key, parts, 1))
    return both.repartition(parts, "_to").sortWithinPartitions("_to", "side").mapInArrow(run, schema)
