"""Best-fit packing with certified bounds.

Texts become token pieces of at most CAPACITY; pieces are dealt to groups of a bounded size, and each group is packed by
best-fit decreasing. Dual-feasible functions give a lower bound on the bins that the group needs: a group that meets its
bound is certified and final. In the others the full bins stay, and the pieces of all bins with room are exchanged
between those groups (dealt anew by another hash, over as many groups as their number asks for) and packed again, ROUNDS
times at most; what the last round packs is final.

A group holds some GROUP pieces at any size of the input: the number of groups grows, not their size. Rounds are written
to the shared folder, so a lost executor repeats at most one.

Cases: a null or empty text is the end token alone; repeated rows are packed each; equal lengths go in the order of
doc_id, then piece, nulls last; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.bpe import vocabulary
from citeweave.llm.common import map_batches, read, rows_of, stored

CAPACITY = 1024
END_TOKEN = 2
#: Pieces in a group, about; rounds of packing at most.
GROUP, ROUNDS = 40_000, 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Ids as the tokenizers file of the same vocabulary gives them, special strings in a text included."""

    def __init__(self, ranks_path: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special, self.special_id = special, len(ranks)
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.special not in text:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        parts = []
        for k, part in enumerate(text.split(self.special)):
            parts += [np.array([self.special_id] * (k > 0), np.uint32), np.array(self.encoding.encode_ordinary(part), np.uint32)]
        return np.concatenate(parts)


@lru_cache(2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, but for a shorter first one."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(b: dict) -> dict:
        encode, rows = tokenizer(path), []
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            ids = np.append(encode(t or ""), np.uint32(end)).astype("<u4")
            rows += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
        return rows_of(rows, [f.split()[0] for f in PIECES.split(", ")])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, taken as given (decreasing), and the number of bins: each goes to the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[k], offsets[k] = b, capacity - room
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins over two families of dual-feasible functions, in whole numbers."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 21):  # x stays if (k+1)x is whole, else floor((k+1)x)/k, as a multiple of 1/(k * capacity)
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    below, total = np.cumsum(count), np.cumsum(count * size)
    for e in range(1, capacity // 2 + 1):  # over capacity-e: a whole bin; under e: nothing
        large = int(below[capacity] - below[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, large + -(-middle // capacity))
    return best


def _pack_group(capacity: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        lengths = table.column("length").to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        certified = last or n == lower_bound(lengths, capacity)
        full = np.bincount(bins, lengths, n) >= capacity
        done = np.full(len(lengths), True) if certified else full[bins]
        number = (np.int64(key[0].as_py()) << 28) + bins
        return pa.table({c: table.column(c) for c in table.column_names if c != "grp"} | {"sequence_id": pa.array(number), "offset": pa.array(offsets), "done": pa.array(done)})

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """parts (columns of PIECES, lengths of 1 to capacity) with sequence_id and offset."""
    schema = f"{PIECES}, sequence_id long, offset long, done boolean"
    todo, final, first, kept, bins = parts, None, 0, None, 0
    for r in range(rounds):
        n = todo.count()
        if not n and final is not None:
            break
        groups = max(1, -(-n // group))
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(groups)) + F.lit(first))
        out = stored(dealt.groupBy("grp").applyInArrow(_pack_group(capacity, r == rounds - 1), schema), f"packed{r}")
        if kept is not None and out.select("sequence_id").distinct().count() >= bins:
            return final.unionByName(kept)  # exchanging documents hasn't saved a sequence
        done = out.where("done").drop("done")
        final = done if final is None else final.unionByName(done)
        kept = out.where("not done").drop("done")
        bins = kept.select("sequence_id").distinct().count()
        todo, first = kept.select(*parts.columns), first + groups
    return final


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")), "pieces"))
