"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols. An index maps each merge rank to all positions of
its pair; the active ranks are taken in ascending order, each merged at all its positions at once, and the lists of the
pairs that arise left and right of a merge are updated. Words are independent, so this equals merging each word by
itself: within a word the lowest rank goes first, its leftmost position first. Finished words are kept for later batches
of the task, up to a bound.

Cases: a null text counts as empty: no tokens, digests of the empty string; the strings of special tokens in a text
become their ids; repeated rows each get a result; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.common import map_batches, read, rows_of, sha256

#: Fixed values of the vocabulary's format: the pattern of its words, the mark of a word's end.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
END = "</w>"
#: Words a task keeps before it starts anew.
KEPT = 1_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def checked(spec: dict) -> None:
    """Raises an error for a file whose text is prepared in another way than here: NFC, white space as one, lower case; words by PATTERN, as bytes; the mark of a word's end."""
    if "normalizer" not in spec:
        return
    steps = [(s["type"], s.get("pattern")) for s in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    same = steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] and split["pattern"]["Regex"] == PATTERN.pattern.replace(r"\p{White_Space}", r"\s")
    same = same and (split["behavior"], split["invert"]) == ("Removed", True) and not level["add_prefix_space"] and not level["use_regex"] and spec["model"]["end_of_word_suffix"] == END
    if not same or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("this vocabulary prepares its text in another way")


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + END] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        self.a, self.b = a.astype(np.int32), b.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        key = a << 32 | b
        self.order = np.argsort(key)
        self.keys = key[self.order]
        # Taking all positions of a rank at once is exact if no merge makes a pair of a lower rank.
        use = np.full(max(vocab.values()) + 1, len(pairs))
        for side in (a, b):
            np.minimum.at(use, side, np.arange(len(pairs)))
        self.monotone = bool((use[self.made] > np.arange(len(pairs))).all())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        checked(spec)
        #: Of each known word, and of each special token by its id: number of ids, their list, the decoded text.
        self.done: dict[str | int, tuple[int, str, str]] = self.specials()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], len(self.keys))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        if not self.monotone and len(words) > 1:
            return [x for w in words for x in self.encode_words([w])]
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        n, none = len(sym), len(self.keys)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Adds the pairs that start at these positions to the index."""
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank < none], rank[rank < none]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, some in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(some)

        note(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.a[r], self.b[r]
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # overlapping pairs: the leftmost goes first
                at, seen, free = at[np.argsort(at)], -1, []
                for p in at.tolist():
                    if p != seen:
                        free.append(p)
                        seen = int(nxt[p])
                    else:
                        seen = -1
                at = np.array(free)
            if not self.monotone:  # one position at a time, as a lower rank may arise
                if len(at) > 1:
                    index[r] = [np.sort(at)[1:]]
                    heapq.heappush(active, r)
                    at = np.sort(at)[:1]
            if not len(at):
                continue
            gone = nxt[at]
            sym[at], sym[gone] = self.made[r], -1
            after = nxt[gone]
            nxt[at], nxt[gone] = after, -1
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            fresh = np.concatenate([before[before >= 0], at[after >= 0]])
            note(np.unique(fresh))
        return np.split(sym[sym >= 0], np.cumsum(np.add.reduceat(sym >= 0, ends - size))[:-1])

    def specials(self) -> dict[str | int, tuple[int, str, str]]:
        return {i: (1, str(i), w) for w, i in self.special.items()}

    def learn(self, words: set[str | int]) -> None:
        """Encodes the words that aren't known yet."""
        if len(self.done) > KEPT:
            self.done = self.specials()
        fresh = [w for w in words if w not in self.done]
        for k in range(0, len(fresh), 200_000):
            some = fresh[k : k + 200_000]
            for w, ids in zip(some, self.encode_words(some), strict=True):
                ids = ids.tolist()
                self.done[w] = (len(ids), " ".join(map(str, ids)), self.decode(ids))

    def split(self, text: str) -> list[str | int]:
        """The words of a text; special tokens by their ids."""
        plain = lambda t: PATTERN.findall(unicodedata.normalize("NFC", t).replace("Σ", "σ").lower())
        if not any(w in text for w in self.special):
            return plain(text)
        out: list[str | int] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if k % 2 else plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The token strings joined by one space: the vocabulary's file names no decoder."""
        return " ".join(map(self.name.__getitem__, ids))

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        self.learn({*words})
        return [int(i) for w in words for i in self.done[w][1].split(" ")]


@lru_cache(2)
def table(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", schema: str = SCHEMA) -> DataFrame:
    """One row per document: the number of tokens and the digests of the ids and of the text decoded from them."""

    def run(b: dict) -> dict:
        bpe, rows = table(path), []
        n, at = len(b["doc_id"]), 0
        while at < n:  # some 4 million characters at a time
            end, size = at, 0
            while end < n and (end == at or size < 4_000_000):
                size += len(b["text"][end] or "")
                end += 1
            texts = [bpe.split(t or "") for t in b["text"][at:end]]
            bpe.learn({w for t in texts for w in t})
            for i, words in zip(b["doc_id"][at:end], texts, strict=True):
                got = [bpe.done[w] for w in words]
                rows.append((i, sum(g[0] for g in got), sha256(" ".join([g[1] for g in got]).encode()), sha256(" ".join([g[2] for g in got]).encode())))
            at = end
        return rows_of(rows, [f.split()[0] for f in SCHEMA.split(", ")])

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, schema)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
