"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over the word numbers of a text in numpy; the characters that lie
inside duplicated n-grams and duplicated lines are measured against fixed thresholds. Equal hashes are confirmed on the
words, so a collision never counts. The work on a row depends on that row only: no shuffle, memory for one text.

Cases: a null or empty text has no words, fails the base rule and isn't kept; repeated rows each get their own result;
an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.common import WORD, map_batches, mix64, read, rolling, rows_of

SYMBOLS = "#*$%&|<>"
#: Fixed values from the published MassiveText rules: share of a text's characters in its most frequent n-gram, inside
#: n-grams seen before, in duplicated lines; share of lines that are duplicates.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINES, LINE_CHARS = 0.30, 0.20
#: The share of lines by number needs two duplicates, as one of three short lines would be above it; the characters of a
#: single one count, and so does every n-gram found twice.
LEAST_LINES = 2

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_chars double, top_share double, dup_share double"


def repeated(ids: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of n ids that start at the positions `at`: those found more than once, and a group number for each."""
    if len(at) < 2:
        return at[:0], at[:0]
    h = rolling(mix64(ids), n)[at]
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = np.zeros(len(hs), bool)
    same[1:] = hs[1:] == hs[:-1]
    if not same.any():
        return at[:0], at[:0]
    group = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)[group]
    starts = at[order]
    equal = np.ones(len(hs), bool)
    for k in range(n):
        equal &= ids[starts + k] == ids[starts[first] + k]
    if not equal.all():  # a collision: number the windows by their words
        windows = np.stack([ids[at + k] for k in range(n)], 1)
        _, number = np.unique(windows, axis=0, return_inverse=True)
        number = number.ravel()
        many = np.bincount(number)[number] > 1
        return at[many], number[many]
    many = np.bincount(group)[group] > 1
    starts, group = starts[many], group[many]
    back = np.argsort(starts)
    return starts[back], group[back]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words at one of the starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    chars = int(lens.sum())
    seen: set[str] = set()
    n_lines = n_dup = line_chars = dup_chars = 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_lines += 1
            line_chars += len(line)
            if line in seen:
                n_dup += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    at = np.arange(max(0, n - 1))
    top = dup = 0.0  # the largest share, as a multiple of its threshold
    n_repeat = 0
    for k in range(2, 11):
        starts, group = repeated(ids, k, at)
        if k == 3 and len(starts):
            n_repeat = int(covered(starts, 3, n).sum())
        if len(starts) and k in TOP:
            size = np.convolve(lens, np.ones(k, np.int64), "valid")[starts]
            top = max(top, float(np.bincount(group, size).max()) / chars / TOP[k])
        elif len(starts):
            again = np.ones(len(starts), bool)  # the first of a group doesn't count, as in a duplicated line
            again[np.unique(group, return_index=True)[1]] = False
            inside = covered(starts[again], k, n)
            dup = max(dup, float(lens[inside].sum()) / chars / DUPLICATED[k])
        # a longer n-gram is found twice only where both shorter ones that it holds are
        flag = np.zeros(n + 1, bool)
        flag[starts] = True
        at = starts[flag[starts + 1]] if len(starts) else starts
        at = at[at + k + 1 <= n]
    lines, in_lines = n_dup / n_lines if n_dup >= LEAST_LINES else 0.0, dup_chars / max(1, line_chars)
    base_failed = n < 50 or 100 * n_repeat > 50 * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed,
        "kept": not base_failed and top <= 1 and dup <= 1 and lines <= LINES and in_lines <= LINE_CHARS,
        "dup_line_share": lines, "dup_line_chars": in_lines, "top_share": top, "dup_share": dup,
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, the repetition measures (n-gram shares as multiples of their thresholds) and `kept`."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(b: dict) -> dict:
        return rows_of([(i, *measure(t).values()) for i, t in zip(b["doc_id"], b["text"], strict=True)], names)

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, SCHEMA)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
