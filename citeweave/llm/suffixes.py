"""Suffix dedup: ranks of positions, sorted in Spark, pruned to those whose strings can still be equal.

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id. This is not prefix doubling with
a row for each position and round, as the README says with figures: a rank and a place of each position that is left
after pruning are alone more than the disk allowed. Ranks are taken at a sample of positions, and there are two sorts:

* SEED bytes. Of the SEED-byte ranks (rolling-hash names) in a LENGTH-byte string the least one stands for it: equal
  strings have equal least ranks, and about one position in 16 is one. These ranks are sorted into buckets; a rank found
  in one text only is unique, and every string that it stands for is dropped. A batch sends each of its ranks once, so a
  rank that a third of all texts hold arrives once per batch.
* LENGTH bytes. Positions that are left are sorted by rank, with the bytes around; their strings of LENGTH bytes are
  ranked by the pair of ranks at half of LENGTH bytes and at as many further on, confirmed on the bytes, and in each
  class of equal ones all but the smallest document lose the string.

Equal texts are one class from the start (by 128 bits of SHA-256): a copy of a document with a smaller id goes whole, if it
has LENGTH bytes at all, and takes no further part. Memory: a batch of texts, a bucket of BUCKET ranks, or CHUNK
positions; a rank with more positions is taken in chunks, whose open strings meet once more by 128 bits of name.

Cases: a null or empty text has no bytes and keeps the digest of nothing; texts shorter than LENGTH stay; rows of one id
are each judged by their own text, as that document; rows without an id stay as they are and don't remove anything; an
empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import map_batches, mix64, read, rolling, sha256, slices, stored

LENGTH, SEED = 50, 20
#: Of a rank; spread evenly, as least values lie close together. Ranks that are equal by chance cost time, not results.
BITS = 44
#: Ranks in a bucket, about, and in the part of it that is sorted at once; bytes of a text that are looked at in one piece; rows
#: of a rank that are compared in one place; bytes of text for a partition, at most; copies of a small side where the other may be skewed.
BUCKET, SLICE, PIECE, CHUNK, PART, SALTS = 2_000_000, 250_000, 4_000_000, 10_000, 256_000_000, 32


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    m = x
    while k * 2 <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (w - k)], m[w - k :]) if w > k else m


def runs(data: bytes, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rank, start, end) of the runs of positions whose string has the same least rank, piece by piece."""
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        values = np.frombuffer(data[at : at + PIECE + length - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        least = sliding_min(rolling(values, seed), length - seed + 1)
        start = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        yield (mix64(least[start]) >> np.uint64(64 - BITS)).astype(np.int64), start + at, np.r_[start[1:], len(least)] + at


def _ranks_blob(ranks: np.ndarray) -> bytes:
    """Sorted ranks as differences, compressed."""
    return zlib.compress(np.diff(ranks, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), 1)


def _blob_ranks(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(6, -1).T
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return np.cumsum(wide.view("<u8").ravel().astype(np.int64))


def _packed(ranks: np.ndarray) -> bytes:
    """Few ranks, six bytes each."""
    return ranks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.int64)


def _seed_batches(n_buckets: int, length: int, seed: int):
    """Texts to (bucket, key, ranks, owners): ranks for a bucket, each with one text that has it; bucket -1: ranks that the text `key` shares within the batch."""

    def run(b: dict) -> dict:
        keys = np.array(b["key"], np.int64)
        ranks, owner = [], []
        seen: set[int] = set()
        for k, (key, own, t) in enumerate(zip(b["key"], b["own"], b["text"], strict=True)):
            if key == own and key not in seen and len(t) * 4 >= length:
                seen.add(key)
                if got := [r for r, _, _ in runs(t.encode(), length, seed)]:
                    mine = np.unique(np.concatenate(got))
                    ranks.append(mine)
                    owner.append(np.full(len(mine), k, np.int32))
        out: dict[str, list] = {"bucket": [], "key": [], "ranks": [], "owners": []}
        if not ranks:
            return out
        rank, who = np.concatenate(ranks), np.concatenate(owner)
        order = np.argsort(rank, kind="stable")
        rank, who = rank[order], who[order]
        first = np.r_[True, rank[1:] != rank[:-1]]
        shared = ~first
        shared[:-1] |= ~first[1:]
        if shared.any():
            by = np.argsort(who[shared], kind="stable")
            ws, rs = who[shared][by], rank[shared][by]
            for part in np.split(np.arange(len(ws)), np.flatnonzero(np.diff(ws)) + 1):
                out["bucket"].append(-1)
                out["key"].append(int(keys[ws[part[0]]]))
                out["ranks"].append(_packed(rs[part]))
                out["owners"].append(b"")
        rank, who = rank[first], who[first]
        bucket = (rank >> BITS - 32) * n_buckets >> 32
        for part in np.split(np.arange(len(rank)), np.flatnonzero(np.diff(bucket)) + 1):
            names, place = np.unique(who[part], return_inverse=True)
            out["bucket"].append(int(bucket[part[0]]))
            out["key"].append(None)
            out["ranks"].append(_ranks_blob(rank[part]))
            out["owners"].append(zlib.compress(np.int32(len(names)).tobytes() + keys[names].tobytes() + place.astype("<u2" if len(names) < 1 << 16 else "<u4").tobytes(), 1))
        return out

    return run


def _owners(blob: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw[:4], np.int32)[0])
    names = np.frombuffer(raw[4 : 4 + 8 * n], np.int64)
    return names[np.frombuffer(raw[4 + 8 * n :], "<u2" if n < 1 << 16 else "<u4")] if size else names[:0]


def _shared_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to (key, ranks): those ranks of the text that another text has too."""

    def answer(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        lists = [_blob_ranks(r) for r, _ in parts]
        owners = [_owners(o, len(x)) for (_, o), x in zip(parts, lists, strict=True)]
        parts.clear()
        low, high = min(int(x[0]) for x in lists), max(int(x[-1]) for x in lists) + 1
        steps = -(-sum(map(len, lists)) // SLICE)
        cuts = [low + (high - low) * k // steps for k in range(steps + 1)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            at = [np.searchsorted(x, (a, z)) for x in lists]
            rank = np.concatenate([x[i:j] for x, (i, j) in zip(lists, at, strict=True)])
            if not len(rank):
                continue
            who = np.concatenate([x[i:j] for x, (i, j) in zip(owners, at, strict=True)])
            order = np.lexsort((who, rank))
            rank, who = rank[order], who[order]
            start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            size = np.diff(np.r_[start, len(rank)])
            several = np.repeat(who[start] != who[start + size - 1], size)
            several[1:] &= (rank[1:] != rank[:-1]) | (who[1:] != who[:-1])
            rank, who = rank[several], who[several]
            if not len(rank):
                continue
            by = np.argsort(who, kind="stable")
            rank, who = rank[by], who[by]
            new = np.flatnonzero(np.diff(who)) + 1
            yield pa.RecordBatch.from_pydict({"key": pa.array(who[np.r_[0, new]]), "ranks": pa.array([_packed(x) for x in np.split(rank, new)], pa.binary())})

    kept: list[tuple[bytes, bytes]] = []
    now = None
    for b in batches:
        bucket = b.column("bucket").to_pylist()
        own = [k for k, x in enumerate(bucket) if x < 0]
        if own:
            yield pa.RecordBatch.from_pydict({"key": b.column("key").take(pa.array(own)), "ranks": b.column("ranks").take(pa.array(own))})
        for k, x in enumerate(bucket):
            if x < 0:
                continue
            if x != now and kept:
                yield from answer(kept)
            now = x
            kept.append((b.column("ranks")[k].as_py(), b.column("owners")[k].as_py()))
    if kept:
        yield from answer(kept)


def _positions(length: int, seed: int):
    """Texts with their shared ranks to (rank, doc_id, which, at, around): runs of positions and the bytes of their strings.

    Of equal runs of one batch only that of the smallest document goes on; the others are covered by it, and are given
    without rank or bytes, as (at, past).
    """

    def run(b: dict) -> dict:
        out: dict[str, list] = {"rank": [], "doc_id": [], "which": [], "at": [], "past": [], "around": []}
        first: dict[bytes, int] = {}
        for i, which, t, blobs in sorted(zip(b["doc_id"], b["which"], b["text"], b["blobs"], strict=True), key=lambda x: x[:2]):
            data = t.encode()
            shared = np.unique(_unpacked(b"".join(blobs)))
            for rank, start, end in runs(data, length, seed):
                on = shared[np.minimum(np.searchsorted(shared, rank), len(shared) - 1)] == rank
                for r, s, e in zip(rank[on].tolist(), start[on].tolist(), end[on].tolist(), strict=True):
                    bytes_ = data[s : e + length - 1]
                    own = first.setdefault(bytes_, i) == i  # texts of one id don't cover each other
                    out["rank"].append(r if own else None)
                    out["doc_id"].append(i)
                    out["which"].append(which)
                    out["at"].append(s)
                    out["past"].append(None if own else s + len(bytes_))
                    out["around"].append(bytes_ if own else None)
        return out

    return run


def _later_strings(length: int, chunk: int):
    """Rows sorted by rank, then document, to (name, high, doc_id, which, a, b): bytes under strings that a smaller document has.

    A rank with more rows than a chunk is taken chunk by chunk, so memory doesn't grow with it. What a chunk can't
    settle alone, its strings that no smaller document of the chunk has, is given with the string's name, for
    _across_chunks().
    """
    half = length // 2

    def exact(strings: np.ndarray, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by string, then document, and where a new string starts."""
        number = np.unique(strings[place], axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((doc, number))
        return order, np.r_[True, np.diff(number[order]) != 0]

    names = ("name", "high", "doc_id", "which", "a", "b")

    def rows(name, high, doc, which, a, b) -> pa.RecordBatch:
        none = lambda: pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([none() if name is None else pa.array(name.view(np.int64)), none() if high is None else pa.array(high.view(np.int64)), *(pa.array(x, pa.int64()) for x in (doc, which, a, b))], names=names)

    def answer(rank: np.ndarray, doc: np.ndarray, which: np.ndarray, at: np.ndarray, around: list[bytes], large: int | None) -> Iterator[pa.RecordBatch]:
        several = rank == (-1 if large is None else large)
        several[1:] |= rank[1:] == rank[:-1]
        several[:-1] |= rank[1:] == rank[:-1]
        pick = np.flatnonzero(several)
        if not len(pick):
            return
        rank, doc, which, at, around = rank[pick], doc[pick], which[pick], at[pick], [around[k] for k in pick.tolist()]
        size = np.array([len(x) for x in around], np.int64)
        data = np.frombuffer(b"".join(around), np.uint8)
        values = data.astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(size) - size
        many = size - length + 1
        row = np.repeat(np.arange(len(size)), many)
        place = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        ranks = rolling(values, half)
        low, high = ranks[place], ranks[place + length - half]  # the pair of ranks; one hash of it, beside the rank of the seed
        name = low * np.uint64(0x9E3779B97F4A7C15) ^ (high << np.uint64(31) | high >> np.uint64(33)) ^ rank[row].astype(np.uint64) << np.uint64(13)
        order = np.lexsort((doc[row], high, name))
        n, h, d = name[order], high[order], doc[row][order]
        new = np.r_[True, (n[1:] != n[:-1]) | (h[1:] != h[:-1])]
        strings = np.lib.stride_tricks.sliding_window_view(data, length)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        for c in range(0, len(order), 1 << 16):  # equal names are confirmed on the bytes
            mine, theirs = order[c : c + (1 << 16)], order[first[c : c + (1 << 16)]]
            if not (strings[place[mine]] == strings[place[theirs]]).all():
                order, new = exact(strings, place, doc[row])
                d = doc[row][order]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                break
        least = d[first]
        goes = np.zeros(len(row), bool)
        goes[order] = d > least
        shift = at[row] + place - begin[row]
        g = np.flatnonzero(goes)
        if len(g):  # neighbouring positions of a run are one span
            new = np.r_[True, (np.diff(g) > 1) | (row[g][1:] != row[g][:-1])]
            a, z = g[new], np.r_[g[np.flatnonzero(new)[1:] - 1], g[-1]]
            yield rows(None, None, doc[row[a]], which[row[a]], shift[a], shift[z] + length)
        if large is not None and len(o := np.flatnonzero(~goes & (rank[row] == large))):
            yield rows(name[o], high[o], doc[row[o]], which[row[o]], shift[o], shift[o] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size, large = 0, None
        for b in batches:
            done = b.filter(pa.compute.is_null(b.column("rank")))
            if done.num_rows:
                yield rows(None, None, *(done.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "which", "at", "past")))
            b = b.filter(pa.compute.is_valid(b.column("rank")))
            if not b.num_rows:
                continue
            kept.append((*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "doc_id", "which", "at")), b.column("around").to_pylist()))
            size += b.num_rows
            if size < chunk:
                continue
            rank, doc, which, at = (np.concatenate([k[c] for k in kept]) for c in range(4))
            around = [x for k in kept for x in k[4]]
            last = int(np.searchsorted(rank, rank[-1]))  # the last rank's rows may go on
            if last:
                kept, size = [(rank[last:], doc[last:], which[last:], at[last:], around[last:])], len(rank) - last
                yield from answer(rank[:last], doc[:last], which[:last], at[:last], around[:last], large)
                large = None if large != rank[-1] else large
            if size >= chunk and rank[0] == rank[-1] or size >= 2 * chunk:
                large = int(rank[-1])
                yield from answer(rank[last:], doc[last:], which[last:], at[last:], around[last:], large)
                kept, size = [], 0
        if size:
            rank, doc, which, at = (np.concatenate([k[c] for k in kept]) for c in range(4))
            yield from answer(rank, doc, which, at, [x for k in kept for x in k[4]], large)

    return run


def _across_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name, high and document to (doc_id, which, a, b): those without a name, and those whose string an earlier document has."""
    now, first = None, None
    for b in batches:
        name, high, doc = (pa.compute.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False) for c in ("name", "high", "doc_id"))
        keep = b.column("name").is_null().to_numpy(zero_copy_only=False).copy()
        for k in np.flatnonzero(~keep).tolist():
            if (name[k], high[k]) != now:
                now, first = (name[k], high[k]), doc[k]
            keep[k] = doc[k] > first
        if keep.any():
            yield b.filter(pa.array(keep)).select(["doc_id", "which", "a", "b"])


def _keep(length: int):
    def spans(data: bytes, cuts: list[tuple[int, int]], copy: bool) -> list[tuple[int, int]]:
        if copy:
            return [(0, len(data))] if len(data) >= length else []
        out: list[tuple[int, int]] = []
        for a, b in sorted(cuts):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    return spans


def _long_ids(docs: DataFrame) -> DataFrame:
    """doc_id as long and text; a plain column stays one, as a renamed one would keep Spark from shuffling the texts once for both uses."""
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.select("doc_id", "text", *(["rest"] if "rest" in docs.columns else []))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text[, rest]) to these and (cuts, copy): the spans of bytes to remove, unmerged, or that the whole text is a copy."""
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    own = [c for c in docs.columns if c != "doc_id"]
    known = texts.where("doc_id is not null")
    salt = 0
    while True:
        named = known.select("doc_id", _key(salt), F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("sha"), F.octet_length("text").cast("long").alias("size"))
        named = stored(named, "names")
        least = stored(named.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("doc_id").alias("last"), F.sum("size").alias("size")), "classes")
        if least.groupBy("key").count().where("count > 1").isEmpty():  # a key is one text's
            break
        salt += 1
    total = least.agg(F.sum("size")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    n_buckets = max(1, -(-int(total * 2 / (length - seed + 2)) // BUCKET))
    several = least.where("rep < last").select("sha", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(several, ["sha", "salt"]).where("doc_id > rep").select("doc_id", "key").distinct()
    # Which text of its id a row is: 0 where ids have one text each, so it costs nothing then.
    mixed = not named.groupBy("doc_id").agg((F.min("key") < F.max("key")).alias("mixed")).where("mixed").isEmpty()
    which = (F.col("key") if mixed else F.lit(0).cast("long")).alias("which")
    on = ["doc_id", "which"] if mixed else ["doc_id"]
    copies = copies.select("doc_id", which).select(*on)
    # Keys are added behind the exchange, so that all uses of the texts read the same one.
    moved = known.repartition(parts, "doc_id", *([_key(salt)] if mixed else []))
    moved, plain = moved.select("*", _key(salt)).select("*", which), moved
    reps = least.where(F.col("size") >= length).select(F.col("rep").alias("doc_id"), which, F.col("key").alias("own")).select(*on, "own")
    seeds = map_batches(moved.join(reps, on), _seed_batches(n_buckets, length, seed), "bucket int, key long, ranks binary, owners binary", ("key", "own", "text"))
    by_key = seeds.repartition(parts, "bucket", F.when(F.col("bucket") < 0, F.pmod("key", F.lit(4096)))).sortWithinPartitions("bucket")
    shared = by_key.mapInArrow(_shared_ranks, "key long, ranks binary")
    for_doc = shared.join(least.select("key", F.col("rep").alias("doc_id"), which), "key").groupBy(*on).agg(F.collect_list("ranks").alias("blobs"))
    positions = map_batches(moved.join(for_doc, on), _positions(length, seed), "rank long, doc_id long, which long, at long, past long, around binary", ("doc_id", "which", "text", "blobs"))
    by_rank = positions.repartition(parts, F.coalesce("rank", F.xxhash64("doc_id"))).sortWithinPartitions("rank", "doc_id")
    found = by_rank.mapInArrow(_later_strings(length, CHUNK), "name long, high long, doc_id long, which long, a long, b long")
    by_name = found.repartition(parts, F.coalesce("name", F.xxhash64("doc_id", "a"))).sortWithinPartitions("name", "high", "doc_id")
    later = by_name.mapInArrow(_across_chunks, "doc_id long, which long, a long, b long")
    cuts = later.groupBy(*on).agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    marks = cuts.join(copies.withColumn("copy", F.lit(True)), on, "full").select(*on, "cuts", F.coalesce("copy", F.lit(False)).alias("copy"))
    none = texts.where("doc_id is null").select("doc_id", *own, F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("cuts"), F.lit(False).alias("copy"))
    return (moved if mixed else plain).join(marks, on, "left").select("doc_id", *own, "cuts", F.coalesce("copy", F.lit(False)).alias("copy")).unionByName(none)


def _key(salt: int) -> F.Column:
    """64 bits that name a text; with another salt where two texts have the same."""
    return (F.xxhash64("text", F.lit(salt)) if salt else F.xxhash64("text")).alias("key")


def _cut(b: dict, length: int):
    spans = _keep(length)
    for i, t, cuts, copy in zip(b["doc_id"], b["text"], b["cuts"], b["copy"], strict=True):
        data = t.encode()
        gone = spans(data, [(c["a"], c["b"]) for c in cuts or ()], copy)
        left, at = [], 0
        for x, y in gone:
            left.append(data[at:x])
            at = y
        yield i, data, gone, b"".join([*left, data[at:]])


def dedup_digest(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(b: dict) -> dict:
        rows = [(i, len(d), sum(y - x for x, y in g), len(g), sha256(left)) for i, d, g, left in _cut(b, length)]
        return dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(repeated_spans(_long_ids(docs), length, seed), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with the texts that are left, n_chars to match, other columns as they are; bytes of a character cut in two go with the others of it. A null text stays null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.col("text").isNull().alias("none"), F.struct(F.lit(0).alias("doc_id"), *others).alias("own"))
    marked = repeated_spans(_long_ids(docs.withColumn("_rest", rest).select("doc_id", "text", F.col("_rest").alias("rest"))), length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            left = [d.decode("utf-8", "ignore") for *_, d in _cut({c: b.column(c).to_pylist() for c in ("doc_id", "text", "cuts", "copy")}, length)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(left, pa.string()), b.column("rest")], names=["doc_id", "text", "rest"])

    out = marked.mapInArrow(run, marked.select("doc_id", "text", "rest").schema)
    text = F.when(~F.col("rest.none"), F.col("text"))
    size = F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text, "n_chars": size}
    return out.select(*[(own[c] if own.get(c) is not None else F.col(f"rest.own.`{c}`")).alias(c) for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(read(spark, sf_dir, "documents"))
