"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: each word (\\w+, lower case) and each word's first four and five letters, hashed to 2**18
numbers; terms in MIN_ROWS rows or more take part, whether or not they go with a label by themselves. A second-order
factorization machine learns a weight for each term and a vector for each, so that a pair of terms (an insult with a
group mention) has a weight of its own, the product of their vectors, that an additive model can't have. Weights start
at the log odds of their term, shrunk to nothing where chance would do, so that training is left with what terms don't
tell one by one; pairs are scaled by the number of a text's terms, the average at least, as else long texts would be all noise. It is fitted
in numpy on a bounded sample of the labelled rows (MAX_TRAIN, the smallest hashes of doc_id, at any size of the input);
the fitted model, 2**18 terms at most, goes to the executors with the code. A score depends on its own text only.

Only labels of rows with crc32(doc_id as text) mod 5 != 0 are learned from, and only texts are scored.
Cases: a null or empty text has no terms and gets the score of the bias alone; without any label of both kinds every
score is the share of toxic labels (0 if there is none); a document with several labels counts once with the largest,
a null label not at all; of a labelled id with several texts the least one is learned from; repeated rows each get a score; empty tables give an empty result; further columns of either
table are passed over.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import filtered, map_batches, read

TERM = re.compile(r"\w+")
BITS = 18
#: The largest number of labelled rows to fit on.
MAX_TRAIN = 12_000
#: Passes over the sample, and batches at least.
FACTORS, EPOCHS, STEPS, BATCH, DECAY = 8, 8, 150, 256, 0.1
#: Steps of bias, weights and vectors, and the spread of the vectors at the start.
BIAS_RATE, WEIGHT_RATE, VECTOR_RATE, SPREAD = 0.3, 0.01, 0.2, 0.02
#: A term takes part if it is in so many rows; its log odds count from so many standard errors on.
MIN_ROWS, MIN_Z = 4, 4.0


def numbers(word: str) -> tuple[int, ...]:
    """The hashed terms of a word."""
    parts = [word] + [f"{word[:k]}*{k}" for k in (4, 5) if len(word) > k]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts)


class Terms:
    """Texts to sorted arrays of distinct term numbers, or of their places in a machine; remembers words, up to a bound."""

    def __init__(self, place: np.ndarray | None = None):
        self.place, self.known = place, {}

    def of(self, word: str) -> tuple[int, ...]:
        if (got := self.known.get(word)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = numbers(word)
            if self.place is not None:
                got = tuple(p for p in self.place[list(got)].tolist() if p >= 0)
            self.known[word] = got
        return got

    def __call__(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for w in set(TERM.findall((text or "").lower())):
            out.update(self.of(w))
        return sorted(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Machine:
    bias: float
    place: np.ndarray  # of each term number in the arrays, -1 for terms that take no part
    weights: np.ndarray
    vectors: np.ndarray
    usual: float = 1.0  # terms of a text, on average

    def logits(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """at: places of all rows' terms, one row after the other."""
        v = self.vectors[at]
        pairs = (sums(v, sizes) ** 2).sum(1) - sums((v**2).sum(1), sizes)
        return self.bias + sums(self.weights[at], sizes) + 0.5 * pairs / np.maximum(sizes, self.usual)


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each row's part of x, from that part alone."""
    out = np.zeros((len(sizes), *x.shape[1:]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Logistic loss, AdaGrad, fixed seed."""
    n, n1 = len(rows), int(labels.sum())
    place = np.full(1 << BITS, -1, np.int32)
    if not 0 < n1 < n:
        share = min(max(n1 / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(share / (1 - share))), place, np.zeros(0), np.zeros((0, FACTORS)))
    sizes = np.array([len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int32)
    owner = np.repeat(labels, sizes)
    seen, pos = np.bincount(at, minlength=1 << BITS), np.bincount(at, owner, minlength=1 << BITS)
    chosen = np.flatnonzero(seen >= MIN_ROWS)
    place[chosen] = np.arange(len(chosen))
    seen, pos, p = seen[chosen], pos[chosen], n1 / n
    z = np.abs(pos - seen * p) / np.sqrt(seen * p * (1 - p))
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((seen - pos + 0.5) / (n - n1 + 1))
    use = place[at] >= 0
    of_row = np.repeat(np.arange(n), sizes)[use]
    at, sizes = place[at[use]], np.bincount(of_row, minlength=n)
    start = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(7)
    m = Machine(float(np.log(p / (1 - p))), place, odds * np.maximum(0, 1 - (MIN_Z / np.maximum(z, 1e-9)) ** 2), rng.normal(0, SPREAD, (len(chosen), FACTORS)), max(1.0, float(np.mean(sizes))))
    g_bias, g_w, g_v = 1.0, np.ones(len(chosen)), np.ones((len(chosen), FACTORS))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            some = order[k : k + BATCH]
            size = sizes[some]
            ids = at[np.repeat(start[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            v = m.vectors[ids]
            err = sigmoid(m.logits(ids, size)) - labels[some]
            touched, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, np.repeat(err, size), len(touched)) + DECAY * m.weights[touched]
            rest = np.repeat(err / np.maximum(size, m.usual), size)[:, None] * (np.repeat(sums(v, size), size, axis=0) - v)
            dv = np.stack([np.bincount(back, rest[:, f], len(touched)) for f in range(FACTORS)], 1) + DECAY * m.vectors[touched]
            g_w[touched] += dw**2
            g_v[touched] += dv**2
            m.weights[touched] -= WEIGHT_RATE * dw / np.sqrt(g_w[touched])
            m.vectors[touched] -= VECTOR_RATE * dv / np.sqrt(g_v[touched])
            g_bias += err.sum() ** 2
            m.bias -= BIAS_RATE * err.sum() / g_bias**0.5
    return m


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN) -> Machine:
    """The machine fitted on the labelled rows outside the held-out fold, max_rows of them at most; only term numbers of those come to the driver."""
    one = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null").where(~held_out("__id"))
    one = one.groupBy("__id").agg((F.max("__y") > 0).cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(one), "__id").groupBy("__id", "__y").agg(F.min("text").alias("text"))
    terms = Terms()
    got = map_batches(texts, lambda b: {"id": b["__id"], "y": b["__y"], "terms": [np.array(terms(t), np.int32).tobytes() for t in b["text"]]}, "id long, y int, terms binary").collect()
    got.sort(key=lambda r: r.id)
    return fit([np.frombuffer(r.terms, np.int32) for r in got], np.array([r.y for r in got], float))


def _probabilities(terms: Terms, machine: Machine, texts: list) -> list[float]:
    rows = [terms(t) for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    return sigmoid(machine.logits(np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum())), sizes)).tolist()


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs without those scored 0.5 or more, all columns as they are."""
    terms = Terms(machine.place)
    return filtered(docs, lambda texts: [p < 0.5 for p in _probabilities(terms, machine, texts)], text_col)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per document."""
    terms = Terms(machine.place)

    def run(b: dict) -> dict:
        p = _probabilities(terms, machine, b["text"])
        return {"doc_id": b["doc_id"], "score": p, "predicted": [int(x >= 0.5) for x in p]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
