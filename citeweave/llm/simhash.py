"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Two fingerprints at distance of at
most T agree, in one of m parts of the bits, up to that part's own threshold, if the thresholds sum to T - m + 1. The
bits that go together (by their correlation over all fingerprints) form a part; m and the thresholds are those of the
least estimated cost, by dynamic programming over the parts: signatures sent, and candidates met, from the shares of the
bits. Fingerprints that share a signature meet in one sorted stream and are verified on all bits.

Equal fingerprints are one class before any of this, so copies cost nothing; a bucket yields a spanning forest of its
links (node, root), never its pairs. A bucket of more than BLOCK rows is dealt out as pairs of blocks, so no task holds
more than two blocks of one bucket. Links become classes by components(), without the driver seeing any.

Cases: a null or empty text has the fingerprint zero and is linked like any other; rows with a null id get a fingerprint
and their own class (null); repeated rows are one class; an empty table gives an empty result; further columns are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import map_batches, read, stored
from citeweave.llm.components import components

BITS, SEED, WIDTH, DISTANCE = 64, 42, 3, 3
#: Rows of a bucket that are compared in one place; candidates that cost as much as sending one signature.
BLOCK, SIGNATURE_COST = 30_000, 20.0


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    words = (text or "").encode().lower().split()  # on bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    h = shingle_hashes(text, width, seed)
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def bit_counts(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together, over all fingerprints, and the number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column("fp").to_numpy().astype("<i8")
            for k in range(0, len(x), 1 << 16):
                bits = np.unpackbits(x[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(BITS * BITS + 1), pa.int32()), "c": pa.array([*both.ravel().astype(np.int64).tolist(), n], pa.int64())})

    got = {r.k: r.c for r in prints.select("fp").mapInArrow(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()}
    return np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS), got.get(BITS * BITS, 0)


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of the bits, of nearly equal sizes, each grown from one bit by the one that goes most with the part."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def allocate(both: np.ndarray, n: int, distance: int = DISTANCE) -> tuple[float, list[tuple[list[int], int]]]:
    """The cheapest (cost, [(part, threshold)]); a part with threshold -1 isn't looked at."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, distance + 2):
        parts = correlated_parts(both, n, m)
        cost = []
        for part in parts:
            chance = np.array([1.0])  # of so many differing bits between two fingerprints
            for b in part:
                chance = np.convolve(chance, [p[b] ** 2 + (1 - p[b]) ** 2, 2 * p[b] * (1 - p[b])])
            row, met, sent = [0.0], 0.0, 0
            for t in range(distance + 1):
                met, sent = met + n * chance[t], sent + comb(len(part), t)
                row.append(met + SIGNATURE_COST * sent)
            cost.append(row)
        want = distance - m + 1 + m  # thresholds count from -1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, picks) in state.items():
                for t, extra in enumerate(row):
                    if used + t <= want and (used + t not in step or c + extra < step[used + t][0]):
                        step[used + t] = (c + extra, [*picks, t - 1])
            state = step
        if state[want][0] < best[0]:
            best = (state[want][0], list(zip(parts, state[want][1], strict=True)))
    return best


def signatures(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(g, fp, node, probe): the part's own bits once, and each variation within the threshold as a probe."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = []
    for k, (part, t) in enumerate(plan):
        mask = signed(sum(1 << b for b in part))
        for d in range(t + 1):
            for flips in combinations(part, d):
                items.append(f"struct(xxhash64({k}, (fp & {mask}L) ^ {signed(sum(1 << b for b in flips))}L) as g, {'true' if d else 'false'} as probe)".replace("-9223372036854775808L", "cast('-9223372036854775808' as bigint)"))
    return prints.select("fp", "node", F.explode(F.expr(f"array({', '.join(items)})")).alias("s")).select("s.g", "fp", "node", "s.probe")


def forest(g: np.ndarray, fp: np.ndarray, node: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by g: (node, root) for each node linked, within a run of equal g, to another with a smaller place."""
    n = len(g)
    root = np.arange(n)
    live = np.flatnonzero(g[:-1] == g[1:]) if n else np.empty(0, np.int64)
    k = 1
    while len(live):
        i, j = live, live + k
        some = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ~(probe[i] & probe[j]) & (root[i] != root[j])
        if some.any():
            for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
            while (root[root] != root).any():
                root = root[root]
        k += 1
        live = live[live + k < n]
        live = live[g[live] == g[live + k]]
    linked = np.flatnonzero(node != node[root])
    return node[linked], node[root[linked]]


def links(rows: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v): a spanning forest of each bucket's links."""
    n = rows.sparkSession
    large = rows.groupBy("g").count().where(F.col("count") > block)
    large = stored(large.select("g", F.ceil(F.col("count") / block).cast("int").alias("b")), "large-buckets")
    if large.limit(1).count():  # each two blocks of such a bucket meet in a group of their own
        met = rows.join(large, "g", "left").withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("b", F.lit(1))).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("b", F.lit(1)) - 1)))
        rows = met.select(F.when(F.col("b").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other"))).alias("g"), "fp", "node", "probe")
    parts = int(n.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size = 0

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            u, v = forest(*cols, distance)
            return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

        for b in batches:
            g, fp, node, probe = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "fp", "node", "probe"))
            kept.append([g, fp.view(np.uint64), node, probe])  # of a signed number bitwise_count takes the absolute value
            size += b.num_rows
            if size < 100_000:
                continue
            cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
            kept, size = [[c[last:] for c in cols]], len(cols[0]) - last
            if last:
                yield done([c[:last] for c in cols])
        if size:
            yield done([np.concatenate(x) for x in zip(*kept, strict=True)])

    return rows.repartition(parts, "g").sortWithinPartitions("g", "node").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""

    def run(b: dict) -> dict:
        fps = np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)
        return {"doc_id": b["doc_id"], "fp": fps}

    prints = stored(map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long"), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    distinct = classes.where("node is not null")
    _, plan = allocate(*bit_counts(distinct), distance)
    found = components(links(signatures(distinct, plan), distance)).withColumnRenamed("component", "low")
    label = classes.join(found, "node", "left").select("fp", F.coalesce("low", "node").alias("component_id"))
    named = prints.join(label, "fp", "left")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest of each class, all columns as they are; of rows repeated under one id the one with the least text stays for each class whose smallest they are. Rows without an id stay. The texts are shuffled at any size, as what goes has no bound."""
    known = stored(near_duplicates(docs, id_col, text_col).where("doc_id is not null"), "classes")
    ids = known.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count(F.lit(1)).alias("n"))
    ids = stored(ids.where("low <> doc_id or n > 1"), "to-go")
    out = docs.join(ids.select(F.col("doc_id").alias(id_col)).hint("merge"), id_col, "left_anti").select(*docs.columns)
    again = ids.where("n > 1")
    if again.isEmpty():
        return out
    rows = docs.join(again.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(F.struct(*docs.columns).alias("row"))
    print_of = F.pandas_udf(lambda texts: texts.map(lambda t: f"{fingerprint(t, WIDTH):016x}"), "string")
    rows = rows.withColumn("doc_id", F.col(f"row.`{id_col}`").cast("long")).withColumn("fingerprint", print_of(F.coalesce(f"row.`{text_col}`", F.lit(""))))
    own = known.where("doc_id = component_id").select("doc_id", "fingerprint", "component_id").distinct()
    first = Window.partitionBy("doc_id", "component_id").orderBy(F.col(f"row.`{text_col}`"), F.hash("row"))
    few = rows.join(own, ["doc_id", "fingerprint"]).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return out.unionByName(few.select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
