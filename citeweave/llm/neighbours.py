"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Vectors of length one are projected by a Gaussian (2-stable) matrix to M dimensions; squared projected distance over
squared distance is then chi-square with M degrees of freedom. A kd-tree holds the projections. Its leaves are visited in
the order of their distance from the projected query, their vectors are verified by the true cosine, and a query stops
when a vector as near as its k-th so far would, with probability SURE, have been projected nearer than the next leaf.

Every vector is indexed once: a kd-tree over the projections of a bounded sample (SAMPLE) cuts the space into cells, and
a cell of more than BLOCK vectors is several blocks, dealt by hash. A query is first searched in its own cell; the k-th
score found there goes with it to all other cells whose box the same stopping test doesn't rule out. In either pass a block's
tree is built once and the queries stream past it. Vectors of one direction are one entry with their k + 1 smallest ids
(cut on the map side), as a query can't return more of them; so copies cost nothing. Entries as near as the k-th are all
kept until ids settle the tie.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
vectors of unlike lengths aren't compared; fewer candidates than k give as many rows; an id given twice is listed once, with
its nearest vector (each of its vectors may take one of the k places of a block); an empty table gives an empty result;
further columns are passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import map_batches, read, stored

K, EVERY, M, SURE, LEAF = 5, 50, 8, 0.95, 64
#: Vectors of a block, about, and queries that are searched at once.
BLOCK, QUERIES = 8_192, 2_048
#: Vectors whose projections the cells are fitted on, and those of them in a cell at least, so there are SAMPLE / PER_CELL cells at most.
SAMPLE, PER_CELL = 20_000, 64
#: Scores that differ by less are compared by id in the end.
CLOSE = 1e-12


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees of freedom, by bisection of its closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if cdf < p else (low, x)
    return high


def kd_leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Places of the points by leaf: split at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        some = points[at]
        dim = int(np.argmax(some.max(0) - some.min(0)))
        order = np.argpartition(some[:, dim], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(dim, m))


def search(index: np.ndarray, queries: np.ndarray, keep: int, m: int = M, sure: float = SURE, leaf: int = LEAF, floor: np.ndarray | None = None, tree: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, index row) places of the `keep` nearest rows found for each query and all as near as the last; rows are of length one, floor: scores below which none is of use."""
    low, leaves, lows, highs = tree or grown(index, m, leaf)
    lowq = queries @ directions(index.shape[1], m)
    bounds = np.stack([(np.maximum(np.maximum(lo - lowq, lowq - hi), 0) ** 2).sum(1) for lo, hi in zip(lows, highs, strict=True)], 1)
    order = np.argsort(bounds, axis=1)
    limit = chi_square_quantile(sure, m)
    best = np.full((len(queries), keep), -np.inf)
    if floor is not None:
        best[:] = floor[:, None]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        nxt = order[active, step]
        far2 = np.maximum(2 - 2 * best[active, -1], 0)  # squared distance of the last kept
        on = bounds[active, nxt] <= limit * far2
        active, nxt = active[on], nxt[on]
        if not len(active):
            break
        by_leaf = np.argsort(nxt, kind="stable")
        for some in np.split(by_leaf, np.flatnonzero(np.diff(nxt[by_leaf])) + 1):
            q, at = active[some], leaves[nxt[some[0]]]
            got = queries[q] @ index[at].T
            r, c = np.nonzero(got >= best[q, -1:] - CLOSE)
            if not len(r):
                continue
            found.append((q[r], at[c], got[r, c]))
            best[q] = -np.sort(-np.concatenate([best[q], got], 1), axis=1)[:, :keep]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    near = score >= best[q, -1] - CLOSE
    return q[near], at[near]


def grown(index: np.ndarray, m: int, leaf: int) -> tuple:
    """The projections, the leaves of their kd-tree, and the corners of each leaf's box."""
    low = index @ directions(index.shape[1], m)
    leaves = kd_leaves(low, leaf)
    return low, leaves, [low[at].min(0) for at in leaves], [low[at].max(0) for at in leaves]


def split_cells(points: np.ndarray, n: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree with n leaves at most, of PER_CELL points at least: (dimension, value, child below, child from it on); a leaf is -1 - its number."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0
    todo = [(np.arange(len(points)), n, -1, 0)]
    while todo:
        at, share, parent, side = todo.pop()
        here = points[at]
        dim = int(np.argmax(here.max(0) - here.min(0))) if len(at) else 0
        value = float(np.median(here[:, dim])) if len(at) else 0.0
        below = here[:, dim] < value if len(at) else np.zeros(0, bool)
        if share < 2 or min(below.sum(), (~below).sum()) < PER_CELL:
            name, leaves = -1 - leaves, leaves + 1
        else:
            name = len(nodes)
            nodes.append((dim, value, 0, 0))
            todo += [(at[below], share // 2, name, 2), (at[~below], share - share // 2, name, 3)]
        if parent >= 0:
            nodes[parent] = (*nodes[parent][:side], name, *nodes[parent][side + 1 :])
    return nodes


def cells_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The leaf that each point falls in."""
    node = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1)
    while (inner := np.flatnonzero(node >= 0)).size:
        for k in np.unique(node[inner]).tolist():
            dim, value, low, high = nodes[k]
            rows = inner[node[inner] == k]
            node[rows] = np.where(points[rows, dim] < value, low, high)
    return -1 - node


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


FOUND = "query_id long, vec_id long, score double"


def _pass(k: int, m: int, sure: float, leaf: int):
    """Rows sorted by dim, cell and part, a block's vectors before its queries, to FOUND: up to k rows of each query and block."""

    def answer(x: np.ndarray, ids: list, tree: tuple, own: list[int], data: list[bytes], floor: list[float]) -> pa.RecordBatch:
        q = _unit(data)
        at, place = search(x, q, k + 1, m, sure, leaf, np.array(floor), tree)
        scores = np.einsum("ij,ij->i", x[place], q[at]).tolist()
        by: list[list[tuple[float, int]]] = [[] for _ in own]
        for r, p, s in zip(at.tolist(), place.tolist(), scores, strict=True):
            by[r] += [(-s, v) for v in ids[p] if v != own[r]]
        rows = [(i, v, -s) for i, f in zip(own, by, strict=True) for v, s in list({v: s for s, v in sorted(f, reverse=True)}.items())[: -k - 1 : -1]]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def run(batches):
        now, kept, ids, x, tree = None, [], [], None, None
        for b in batches:
            rows = b.to_pydict()
            key = list(zip(rows["dim"], rows["cell"], rows["part"], strict=True))
            asked: list[int] = []

            def flush():
                nonlocal x, tree
                if asked and kept:
                    if tree is None:
                        x = _unit(kept)
                        tree = grown(x, m, leaf)
                    for c in range(0, len(asked), QUERIES):
                        some = asked[c : c + QUERIES]
                        yield answer(x, ids, tree, [rows["ids"][r][0] for r in some], [rows["data"][r] for r in some], [rows["floor"][r] for r in some])
                asked.clear()

            for r, is_query in enumerate(rows["is_query"]):
                if key[r] != now:
                    yield from flush()
                    now, kept, ids, tree = key[r], [], [], None
                if is_query:
                    asked.append(r)
                else:
                    kept.append(rows["data"][r])
                    ids.append(rows["ids"][r])
            yield from flush()

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, block: int = BLOCK, m: int = M, sure: float = SURE, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`."""
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null")

    def clean(b: dict) -> dict:
        rows = []
        for i, v in zip(b["vec_id"], b["v"], strict=True):
            if not v or None in v:
                continue
            x = np.array(v, kind).astype(float)
            if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                rows.append((i, (x / top + 0.0).tobytes()))  # the direction: equal for multiples, and its squares stay finite
        return {"vec_id": [r[0] for r in rows], "data": [r[1] for r in rows]}

    rows = stored(map_batches(named, clean, "vec_id long, data binary"), "vectors")
    first = Window.partitionBy("data").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = stored(few.groupBy("data").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    n_cells = max(1, min(-(-entries.count() // block), sample // PER_CELL))

    def project(b: dict) -> dict:
        return {"dim": [len(d) // 8 for d in b["data"]], "low": [(_unit([d]) @ directions(len(d) // 8, m)).tobytes() for d in b["data"]]}

    trees: dict[int, list] = {}
    if n_cells > 1:
        chosen = map_batches(entries.orderBy(F.xxhash64("data"), "data").limit(sample), project, "dim int, low binary").collect()
        for dim in {r.dim for r in chosen}:
            trees[dim] = split_cells(np.frombuffer(b"".join(sorted(r.low for r in chosen if r.dim == dim))).reshape(-1, m), n_cells)

    def place(b: dict) -> dict:
        out = {"ids": b["ids"], "data": b["data"], "dim": [], "cell": [], "low": []}
        for d in b["data"]:
            dim = len(d) // 8
            low = _unit([d]) @ directions(dim, m)
            out["dim"].append(dim)
            out["cell"].append(int(cells_of(low, trees.get(dim, []))[0]))
            out["low"].append(low[0].tolist())
        return out

    placed = "ids array<long>, data binary, dim int, cell int, low array<double>"
    index = stored(map_batches(entries, place, placed), "index")
    asked = stored(map_batches(rows.where(F.col("vec_id") % every == 0).distinct().select(F.array("vec_id").alias("ids"), "data"), place, placed), "asked")
    corner = lambda f: F.array(*[f(F.col("low")[j]) for j in range(m)])
    boxes = F.broadcast(index.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), corner(F.min).alias("lo"), corner(F.max).alias("hi")))
    sized = index.join(boxes.select("dim", "cell", "parts"), ["dim", "cell"])
    blocks = sized.select(F.lit(False).alias("is_query"), "ids", "data", "dim", "cell", F.pmod(F.xxhash64("data"), F.col("parts")).cast("int").alias("part"), F.lit(0.0).alias("floor"))

    def searched(queries: DataFrame) -> DataFrame:
        """queries with the cell to look at, its parts and their floor."""
        each = queries.select(F.lit(True).alias("is_query"), "ids", "data", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "floor")
        both = blocks.unionByName(each).repartition(parts, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "is_query")
        return both.mapInArrow(_pass(k, m, sure, leaf), FOUND)

    home = stored(searched(asked.join(boxes, ["dim", "cell"]).withColumn("floor", F.lit(-2.0))), "home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    once = home.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = once.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("floor"))
    others = asked.withColumnRenamed("cell", "home").join(boxes, "dim").where("cell <> home")
    others = others.withColumn("query_id", F.col("ids")[0]).join(last, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    gap2 = sum((F.pow(F.greatest(F.col("lo")[j] - F.col("low")[j], F.col("low")[j] - F.col("hi")[j], F.lit(0.0)), F.lit(2.0)) for j in range(m)), F.lit(0.0))
    found = home
    if n_cells > 1:
        found = home.unionByName(searched(others.where(gap2 <= chi_square_quantile(sure, m) * (2 - 2 * F.col("floor")))))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
