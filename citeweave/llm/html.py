"""HTML main text with a host suffix array.

Each page is cut into blocks of text (an element that stands alone starts a new one); markup, scripts, styles and
comments go, character references are decoded. Blocks inside an article or main element are the page's own text, however
often it is published, and stay. Elements whose tag, role or class says outright that they are a menu, header, footer,
sidebar, notice, advert, form or reader comment go; a class does so only if all its parts are such words. All other blocks
are candidates: their token streams are concatenated, distinct page contents of a host together, and a suffix array with
its longest common prefixes gives the substrings of RUN tokens or more that stand on SHARE of the host's pages, PAGES at
least. A candidate block that such substrings cover whole is boilerplate and goes; all other blocks stay whole.

A host's contents are dealt to groups of some GROUP_TOKENS, so a host with a third of all pages is many groups. What stands
on SHARE of the host's pages stands on SHARE of some group's: each group names those substrings, then every group counts
all that were named, and the host's totals decide. So the result doesn't depend on the groups. Pages with equal blocks
are one content, moved and counted once.

Cases: null or empty html gives the empty text; a page without any such element is all candidates; a null url is a host
of its own; repeated rows each get a result; tags are scanned in linear time, an open quote or tag at the end too; an empty
table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import map_batches, read, stored

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements whose text isn't shown, elements without an end, elements that stand alone.
UNSEEN = frozenset("script style noscript template head title iframe object svg math canvas select option datalist textarea audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALONE = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OWN = frozenset(("article", "main"))
OTHER = frozenset("nav header footer aside form button menu dialog fieldset label".split())
#: Words of class, id and role that mark what isn't the article: anywhere, and outside an article only.
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social comment comments reply replies disqus form search login related recommended".split())
AROUND = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget widgets pagination pager toolbar copyright complementary contentinfo".split())
#: Words that say where on a page, beside one of the others.
PLACES = frozenset("site page global top bottom left right upper lower main primary secondary bar box list section area block container wrapper".split())
ENDS_P = ALONE - {"br", "body", "html"}

#: Tokens of a repeated substring; pages of the host that have it, at least and as a share; tokens of a group, about.
RUN, PAGES, SHARE, GROUP_TOKENS = 6, 2, 0.1, 400_000


def marked(attrs: str, own: bool) -> bool:
    if not attrs or attrs.isspace():
        return False
    words = MARKS if own else MARKS | AROUND
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id", "role"):
            for token in value.lower().split():
                parts = [p for p in re.split(r"[^a-z]+", token) if p]
                if not words.isdisjoint(parts) and all(p in words or p in PLACES for p in parts):
                    return True
    return False


def tag_end(page: str, at: int, open_: set[str]) -> int:
    """Where the tag that goes on at `at` ends: past the next > that isn't in a quoted value. open_: quotes that don't occur any more."""
    while m := STOP.search(page, at):
        at, q = m.end(), m[0]
        if q == ">":
            return at
        if q not in open_ and page[max(0, m.start() - 8) : m.start()].rstrip()[-1:] == "=":
            close = page.find(q, at)
            if close < 0:
                open_.add(q)
            else:
                at = close + 1
    return len(page)


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, own) in page order: own for blocks of the article; what is marked as another kind is left out."""
    page = page or ""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, text goes, own
    opened: Counter[str] = Counter()
    parts: list[str] = []
    no_more: set[str] = set()
    goes = own = False
    at = done = 0

    def end_block() -> None:
        if parts:
            if text := SPACE.sub(" ", entities.unescape("".join(parts))).strip():
                out.append((text, own))
            parts.clear()

    def close(name: str) -> None:
        nonlocal goes, own
        while (last := stack.pop()[0]) != name:
            opened[last] -= 1
        opened[name] -= 1
        goes, own = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def after(what: str, start: int) -> int:
        k = page.find(what, start)
        return k + len(what) if k >= 0 else len(page)

    while (at := page.find("<", at)) >= 0:
        name = None
        if page.startswith("<!--", at):
            past = after("-->", at + 4)
        elif page.startswith("<![CDATA[", at):
            past = after("]]>", at)
        elif page.startswith(("<!", "<?"), at):
            past = after(">", at)
        else:
            ends = page[at + 1 : at + 2] == "/"
            name = NAME.match(page, at + 1 + ends)
            if not name:
                at += 1
                continue
            past = tag_end(page, name.end(), no_more)
        if not goes and at > done:
            parts.append(page[done:at])
        if name is None:
            at = done = past
            continue
        attrs, name, at = page[name.end() : past].removesuffix(">"), name[0].lower(), past
        done = at
        if name in ALONE:
            end_block()
        if ends:
            if opened[name]:
                if name in UNSEEN and not goes:
                    end_block()
                close(name)
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":  # a paragraph ends where a block starts
            close("p")
        if name == "body" and opened["head"]:
            close("head")
        if name in VOID or attrs.endswith("/") and name not in ALONE and name not in RAW:
            continue
        if name in RAW:  # up to its own end tag, whatever is in between
            m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = done = m.end() if m else len(page)
            continue
        quits = name in UNSEEN or (name in OTHER and not (own and name in ("header", "label"))) or (name not in ("html", "body") and marked(attrs, own))
        own = not quits and (own or name in OWN)
        goes = goes or quits
        stack.append((name, goes, own))
        opened[name] += 1
    if not goes and done < len(page):
        parts.append(page[done:])
    end_block()
    return out


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of x (numbers) in the order of their suffixes, by prefix doubling, and the longest common prefix of each with the one before it."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].ravel() + 1
    ranks, k = [rank], 1
    while k < n and int(rank.max()) < n:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].ravel() + 1
        ranks.append(rank)
        k *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        size = 1 << level
        same = np.flatnonzero((a + size <= n) & (b + size <= n))
        same = same[ranks[level][a[same]] == ranks[level][b[same]]]
        common[same + 1] += size
        a[same] += size
        b[same] += size
        a[same], b[same] = np.minimum(a[same], n), np.minimum(b[same], n)
    return order, common


def joined(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all streams, each with an end that no other has, and the stream of each token."""
    number: dict[str, int] = {}
    ids, owner = [], []
    for k, s in enumerate(streams):
        ids += [number.setdefault(w, len(number)) for w in s]
        ids.append(-1 - k)
        owner += [k] * (len(s) + 1)
    return np.array(ids, np.int64), np.array(owner, np.int64)


def repeated_runs(streams: list[list[str]], run: int, least: float) -> dict[str, int]:
    """The substrings of `run` tokens that stand in `least` streams or more, with the number of these."""
    x, owner = joined(streams)
    if not len(x):
        return {}
    order, common = suffix_array(x)
    rest = np.cumsum([len(s) + 1 for s in streams])[owner] - np.arange(len(x)) - 1  # tokens up to the stream's end
    whole = rest[order] >= run
    group = np.cumsum(common < run) - 1  # neighbours with a common prefix of `run` tokens are one interval
    pairs = np.unique(np.stack([group[whole], owner[order[whole]]], 1), axis=0)
    counts = np.bincount(pairs[:, 0], minlength=int(group[-1]) + 1)
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    words = [w for s in streams for w in (*s, "")]
    return {" ".join(words[order[firsts[g]] : order[firsts[g]] + run]): int(counts[g]) for g in np.flatnonzero(counts >= least).tolist()}


def covered(tokens: list[str], runs: set[str], run: int) -> np.ndarray:
    """Which tokens lie in one of the runs."""
    edge = np.zeros(len(tokens) + 1, np.int64)
    for k in range(len(tokens) - run + 1):
        if " ".join(tokens[k : k + run]) in runs:
            edge[k] += 1
            edge[k + run] -= 1
    return np.cumsum(edge[:-1]) > 0


def cleaned(texts: list[str], own: list[bool], runs: set[str], run: int) -> str:
    """The blocks that stay, joined."""
    words = [[] if o else t.split(" ") for t, o in zip(texts, own, strict=True)]
    flags = covered([w for ws in words for w in ws], runs, run) if runs else None
    keep, at = [], 0
    for t, o, ws in zip(texts, own, words, strict=True):
        if o or flags is None or not flags[at : at + len(ws)].all():
            keep.append(t)
        at += len(ws)
    return "\n".join(keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least: int = PAGES, share: float = SHARE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def cut(b: dict) -> dict:
        parts = [blocks(h) for h in b["html"]]
        hosts = [re.sub(r"^[a-zA-Z][\w+.-]*://", "", u or "").split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].lower() for u in b["url"]]
        loose = [[t for t, o in p if not o] for p in parts]
        key = [xxhash.xxh3_128_digest("\n".join(f"{o:d}{t}" for t, o in p)) for p in parts]
        return {"page_id": b["page_id"], "url": b["url"], "host": hosts, "key": key, "n": [sum(t.count(" ") + 1 for t in p) for p in loose], "texts": [[t for t, _ in p] for p in parts], "own": [[o for _, o in p] for p in parts]}

    schema = "page_id long, url string, host string, key binary, n long, texts array<string>, own array<boolean>"
    rows = stored(map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), cut, schema), "blocks")
    plain = rows.where("n = 0").select("page_id", "url", F.array_join("texts", "\n").alias("text"))
    some = rows.where("n > 0")
    if some.isEmpty():
        return plain.withColumn("n_chars", F.length("text").cast("long"))

    salts = 32
    number = lambda c: F.ceil(F.sum(c) / group_tokens).cast("int")

    def dealt(df: DataFrame, hosts: DataFrame, groups: str, by: str) -> DataFrame:
        """df with a group of its host; a host's row is salted, as one host may hold most of df."""
        each = hosts.select("host", groups, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        salted = df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(each, ["host", "salt"])
        return salted.withColumn("grp", F.pmod(F.xxhash64(by, F.lit(1)), F.col(groups)).cast("int")).drop("salt", groups)

    stream = F.filter(F.arrays_zip("texts", "own"), lambda x: ~x["own"])
    contents = some.groupBy("host", "key").agg(F.first("n").alias("n"), F.first(F.transform(stream, lambda x: x["texts"])).alias("stream"))
    contents = stored(contents, "contents")
    hosts = contents.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), number("n").alias("groups"))
    hosts = stored(hosts.join(some.groupBy("host").agg(number("n").alias("page_groups")), "host"), "hosts")
    mine = dealt(contents.select("host", "key", "stream"), hosts, "groups", "key")
    tokens = lambda table: [[w for t in s for w in t.split(" ")] for s in table.column("stream").to_pylist()]

    def name_runs(table: pa.Table) -> pa.Table:
        found = list(repeated_runs(tokens(table), run, share * table.num_rows - 1e-9))
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(found), pa.string()), "run": pa.array(found, pa.string())})

    def count_runs(table: pa.Table, asked: pa.Table) -> pa.Table:
        wanted, found = set(asked.column("run").to_pylist()), Counter()
        for s in tokens(table):
            found.update({g for k in range(len(s) - run + 1) if (g := " ".join(s[k : k + run])) in wanted})
        host = asked.column("host")[0].as_py() if asked.num_rows else ""
        return pa.table({"host": pa.array([host] * len(found), pa.string()), "run": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    def keep_blocks(table: pa.Table, runs: pa.Table) -> pa.Table:
        gone = set(runs.column("run").to_pylist())
        text = [cleaned(t, o, gone, run) for t, o in zip(table.column("texts").to_pylist(), table.column("own").to_pylist(), strict=True)]
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(text, pa.string())})

    def at_each(runs: DataFrame, groups: str) -> DataFrame:
        return runs.join(hosts.select("host", groups), "host").select("host", "run", F.explode(F.sequence(F.lit(0), F.col(groups) - 1)).alias("grp"))

    named = stored(mine.groupBy("host", "grp").applyInArrow(name_runs, "host string, run string").distinct(), "runs")
    counted = mine.groupBy("host", "grp").cogroup(at_each(named, "groups").groupBy("host", "grp")).applyInArrow(count_runs, "host string, run string, n long")
    enough = F.greatest(F.lit(least), F.ceil(F.col("pages") * F.lit(share) - 1e-9))
    common = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(hosts, "host").where(F.col("n") >= enough).select("host", "run")
    theirs = dealt(some.select("page_id", "url", "host", "texts", "own"), hosts, "page_groups", "page_id")
    kept = theirs.groupBy("host", "grp").cogroup(at_each(stored(common, "boilerplate"), "page_groups").groupBy("host", "grp")).applyInArrow(keep_blocks, "page_id long, url string, text string")
    return plain.unionByName(kept).withColumn("n_chars", F.length("text").cast("long"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
