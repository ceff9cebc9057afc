"""String similarity: the normalised Indel ratio, 100 * (1 - (|a| + |b| - 2 LCS) / (|a| + |b|)).

indel_ratio gets the longest common subsequence from bit vectors, in Arrow batches: some microseconds a pair, where
the native form, a row of the usual table carried through nested higher-order functions, takes over a hundred (they
aren't compiled). Callers score distinct pairs of names after an equi-join, and drop pairs whose lengths alone rule the
threshold out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from citeweave.functions.text import words


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def lcs_length(a: Column, b: Column) -> Column:
    left, right = letters(a), letters(b)
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            k = F.size(done)
            value = F.when(F.get(right, j) == x, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.get(done, k - 1)))
            return F.concat(done, F.array(value))

        # an empty right side has no columns: its row stays [0]
        return F.when(F.length(b) == 0, above).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0))), F.array(F.lit(0)), cell))

    return F.element_at(F.aggregate(left, start, row), -1)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence: the places of a not yet used are the ones of a bit vector."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    free = full
    for x in b:
        hit = free & places.get(x, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def pair_ratio(x: str | None, y: str | None) -> float | None:
    if x is None or y is None:
        return None
    total = len(x) + len(y)
    return 100.0 if x == y else (1 - (total - 2 * common_length(x, y)) / total) * 100


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pair_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100; two empty texts are alike."""
    return pandas_udf(ratios, "double")(a, b)


def indel_ratio_native(a: Column, b: Column) -> Column:
    """indel_ratio without leaving the JVM."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when(a == b, 100.0).otherwise((1 - (total - 2 * lcs_length(a, b)) / total) * 100)


def could_reach(a: Column, b: Column, ratio: Column | float) -> Column:
    """Whether the lengths let the ratio (0 to 100) be reached."""
    short, total = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return 200.0 * short >= ratio * total


def signatures(texts: pd.Series, levels: int) -> pd.Series:
    """Of each text: for each level the letters (as bits, by code point modulo 63) that it has so many times, then how many letters are left out."""

    def one(x: str | None) -> list[int] | None:
        if x is None:
            return None
        counts = Counter(ord(c) % 63 for c in x)
        masks = [sum(1 << b for b, n in counts.items() if n > level) for level in range(levels)]
        return [*masks, len(x) - sum(m.bit_count() for m in masks)]

    return texts.map(one)


def signature(c: Column, levels: int) -> Column:
    return pandas_udf(lambda s: signatures(s, levels), "array<bigint>")(c)


def could_share(a: Column, b: Column, sig_a: Column, sig_b: Column, levels: int, ratio: Column | float) -> Column:
    """Whether the letters that two texts have in common, whatever their order, let the ratio (0 to 100) be reached; a few bit operations."""
    common = sum((F.bit_count(sig_a[k].bitwiseAND(sig_b[k])) for k in range(levels)), F.least(sig_a[levels], sig_b[levels]))
    return 200.0 * common >= ratio * (F.length(a) + F.length(b)) - 1e-6


class Block:
    """Texts side by side, which one text is compared with at once: `bounds` by their letters, whatever the order, then `ratios` (both 0 to 1) of those that count."""

    def __init__(self, texts: list[str], levels: int = 6):
        self.texts, self.levels = texts, levels
        self.sizes = np.array([len(x) for x in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        known, code = np.unique(points, return_inverse=True)
        self._code = {p: k + 1 for k, p in enumerate(known.tolist())}
        self._codes = np.zeros((int(self.sizes.max(initial=0)), len(texts)), np.int32)  # a row for each place, 0 past the end
        self._codes[np.arange(len(points)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes), owner] = code + 1
        counts = np.bincount(owner * 63 + points % 63, minlength=63 * len(texts)).reshape(len(texts), 63)
        bits = np.uint64(1) << np.arange(63, dtype=np.uint64)
        self._masks = [np.where(counts > k, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64) for k in range(levels)]
        self._left = np.maximum(counts - levels, 0).sum(axis=1)

    def bounds(self, text: str) -> np.ndarray:
        """What no ratio of the text with one of these can be above; see could_share."""
        counts = Counter(ord(c) % 63 for c in text)
        common = np.minimum(self._left, sum(max(0, n - self.levels) for n in counts.values()))
        for k, mask in enumerate(self._masks):
            common = common + np.bitwise_count(mask & np.uint64(sum(1 << b for b, n in counts.items() if n > k)))
        total = self.sizes + len(text)
        return np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1)) + 1e-9

    def ratios(self, text: str, at: np.ndarray) -> np.ndarray:
        """indel_ratio / 100 of the text with these at places `at`: the bit vectors of common_length, a word of 64 places after the other, for all of them at once (a few go one by one)."""
        if len(at) < 24:
            return np.array([pair_ratio(text, self.texts[k]) for k in at.tolist()], np.float64) / 100
        words = max(1, -(-len(text) // 64))
        places = np.zeros((words, len(self._code) + 1), np.uint64)
        for k, x in enumerate(text):
            if (c := self._code.get(ord(x))) is not None:
                places[k // 64, c] |= np.uint64(1 << k % 64)
        sizes = self.sizes[at]
        free = np.full((words, len(at)), ~np.uint64(0))
        for codes in self._codes[: int(sizes.max(initial=0)), at]:
            carry = np.zeros(len(at), np.uint64)
            for w in range(words):
                hit = free[w] & places[w, codes]
                total = free[w] + hit
                over = total < hit
                total += carry
                over |= total < carry
                free[w] = total | (free[w] & ~hit)
                carry = over.astype(np.uint64)
        common = np.bitwise_count(~free).sum(axis=0, dtype=np.int64)
        total = sizes + len(text)
        some = np.maximum(total, 1)
        return np.where(total == 0, 100.0, (1 - (total - 2 * common) / some) * 100) / 100


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def title_form(c: Column) -> Column:
    """Lower case, anything but letters, digits, underscores and white space as a space."""
    return F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")


def token_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    order = lambda x: None if x is None else " ".join(sorted(x.split()))
    return ratios(a.map(order), b.map(order))
