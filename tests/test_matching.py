"""The cascade against a plain reading of its rules, row by row."""

import random

import pytest

from citeweave.functions.similarity import common_length
from citeweave.functions.text import PARTICLES
from citeweave.operators import matching

T = matching.Thresholds()


def ratio(a, b):
    n = len(a) + len(b)
    return 1.0 if not n else ((1 - (n - 2 * common_length(a, b)) / n) * 100) / 100


def bare(name):
    words = name.split()
    while len(words) > 1 and words[0].lower() in PARTICLES:
        words = words[1:]
    return " ".join(words).lower()


def score(c, item, year, penalty=True):
    names = item["authors"] or item["editors"]
    if not names or not names[0].strip() or (c["has_et_al"] and len(names) < 3):
        return 0.0
    best = 0.0
    for a in {c["authors"][0].lower(), bare(c["authors"][0])}:
        for b in {names[0].lower(), bare(names[0])}:
            if a[0] == b[0]:
                s = ratio(a, b)
                if len(c["authors"]) > 1 and len(names) > 1:
                    s = 0.7 * s + 0.3 * ratio(bare(c["authors"][1]), bare(names[1]))
                elif len(c["authors"]) > 1 and penalty:
                    s *= 0.85
                best = max(best, s)
    return best


def expected(c, lib):
    if not c["authors"]:
        return "unmatched", None, 0.0
    numeric = c["year"][:4].isdigit()
    pool = lambda y: [i for i in lib if i["year"][:4] == y]
    year = c["year"][:4] if numeric else ""
    look = pool(year) or ([] if numeric else lib)
    hits = sorted([(-score(c, i, year), i["lib_ord"], i["item_key"]) for i in look if score(c, i, year) >= T.author / 100])
    if hits:
        return ("ambiguous" if len(hits) > 1 else "matched"), hits[0][2], -hits[0][0]
    if numeric:
        best = None
        for k in (-1, 1):
            for i in sorted(pool(str(int(year) + k)), key=lambda i: (-score(c, i, ""), i["lib_ord"]))[:1]:
                s = score(c, i, "")
                if s >= T.author / 100 and (best is None or s > best[0]):
                    best = (s, i["item_key"])
        if best:
            return "suggestion", best[1], best[0] * 0.8
    low = []
    for k, y in enumerate([year, str(int(year) - 1), str(int(year) + 1)] if numeric else [""]):
        p = 1.0 if k == 0 else 0.9
        for i in pool(y) if numeric else lib:
            s = score(c, i, y, penalty=False) * p
            if T.candidate / 100 <= s < T.author / 100:
                low.append((-s, k, i["lib_ord"], i["item_key"]))
    if low:
        return "ambiguous", min(low)[3], -min(low)[0]
    a = bare(c["authors"][0])
    near = [(-ratio(a, bare(n[0])), i["lib_ord"], i["item_key"]) for i in lib if (n := i["authors"] or i["editors"]) and n[0].strip() and bare(n[0])[0] == a[0]]
    if near and -min(near)[0] >= 0.7:
        return "last_resort", min(near)[2], -min(near)[0] * 0.5
    return "unmatched", None, 0.0


@pytest.mark.parametrize("undated", [True, False])
def test_cascade(spark, undated):
    rng = random.Random(5)
    stems = ["Smith", "Smyth", "Smithe", "van Berg", "Berg", "Bergman", "de la Cruz", "Cruz", "Nilsson", "Nielsen", "Olsen", "Zed"]
    name = lambda: rng.choice(stems) if rng.random() < 0.7 else "".join(rng.choices("SBCN", k=1) + rng.choices("aeimnrst", k=5))
    years = ["2000", "2001", "2001-05", "2003"] + [""] * undated
    lib = [{"lib_ord": k, "item_key": f"K{k}", "authors": [name() for _ in range(rng.randint(0, 3))], "editors": [name()] if k % 4 else [], "title": "t", "year": rng.choice(years)} for k in range(120)]
    lib[3]["authors"] = [" "]
    cites = [{"cit_id": k, "doc_id": 1, "authors": [name() for _ in range(rng.randint(0, 2) if k % 9 else 1)], "year": rng.choice(["2000", "2001a", "2002", "2003", "2009", "in press", ""]), "has_et_al": k % 7 == 0} for k in range(300)]
    got = matching.cascade(
        spark.createDataFrame(cites, "cit_id long, doc_id long, authors array<string>, year string, has_et_al boolean"),
        spark.createDataFrame(lib, "lib_ord long, item_key string, authors array<string>, editors array<string>, title string, year string"),
    ).collect()
    assert len(got) == len(cites)
    by = {r.cit_id: r for r in got}
    for c in cites:
        outcome, key, s = expected(c, lib)
        r = by[c["cit_id"]]
        assert (r.outcome, r.item_key, round(r.confidence, 9)) == (outcome, key, round(s, 9)), (c, r)


CITES = "cit_id long, doc_id long, authors array<string>, year string, has_et_al boolean"
ITEMS = "lib_ord long, item_key string, authors array<string>, editors array<string>, title string, year string"


def test_steps_between_profiles(spark, monkeypatch):
    """300 citations that say the same, of 40 items that do: the steps store the 40 candidates, not 12,000."""
    entries = []

    def counted(df, name, stored=matching.stored):
        out = stored(df, name)
        entries.append(sum(len(r.candidates or []) if "candidates" in out.columns else 1 for r in out.collect()))
        return out

    monkeypatch.setattr(matching, "stored", counted)
    cites = spark.createDataFrame([(k, k % 3, ["Smith"], "2000", False) for k in range(300)], CITES)
    lib = spark.createDataFrame([(k, f"K{k % 39}", ["Smith"], [], "t", "2000") for k in range(40)], ITEMS)
    got = matching.cascade(cites, lib).collect()
    assert max(entries) <= 40
    assert [(r.outcome, r.item_key, len(r.candidates)) for r in got] == [("ambiguous", "K0", 39)] * 300  # K0 is there twice and counts once


def test_titles_of_many_items(spark):
    """Of the items of a title the first wins, but the first of the year asked for where its bonus counts."""
    lib = spark.createDataFrame([(k, f"K{k}", ["A"], [], "birds of the north" if k % 2 else "fish", str(2000 + k % 5)) for k in range(200)], ITEMS)
    texts = ["birds of the north", "birds of north", "fish", "quite another text"]
    cites = spark.createDataFrame([(k, texts[k % 4], str(1999 + k % 7)) for k in range(28)], "cit_id long, raw_text string, year string")
    items = [(k, "birds of the north" if k % 2 else "fish", str(2000 + k % 5)) for k in range(200)]
    order = lambda t: " ".join(sorted(t.split()))
    for r in matching.title_match(cites, lib).collect():
        text, year = texts[r.cit_id % 4], str(1999 + r.cit_id % 7)
        best, first = max(((min(1.0, s * 1.15) if y == year else s), -k) for k, t, y in items for s in [ratio(order(text), order(t))])
        assert (round(r.score, 9), r.matched, r.lib_ord) == (round(best, 9), best >= 0.68, -first if best >= 0.68 else None)


def test_met_as_spark_joins(spark):
    """Rows that cross packed, against Spark's own join: keys that repeat, are null or stand on one side only, nested columns, an empty side."""
    from citeweave.operators.packed import met

    left = spark.createDataFrame([(k % 70 if k % 9 else None, f"text {k % 3}", [f"a{k}", None], [("x", k / 2)]) for k in range(200)], "id long, t string, names array<string>, c array<struct<k: string, s: double>>").repartition(3)
    right = spark.createDataFrame([(k if k % 7 else None, "yes" if k % 2 else None, k) for k in [*range(40, 90), 50, 50, 60]], "id long, action string, pick int").repartition(2)
    rows = lambda df: sorted(map(str, df.collect()))
    for how in ("left", "inner"):
        for other in (right, right.limit(0)):
            got = met(left, other, "id", how).select("id", "t", "names", "c", "action", "pick")
            assert rows(got) == rows(left.join(other, "id", how).select("id", "t", "names", "c", "action", "pick"))
    texts = left.withColumn("id", left["id"].cast("string"))
    assert rows(met(texts, right.withColumn("id", right["id"].cast("string")), "id")) == rows(texts.join(right.withColumn("id", right["id"].cast("string")), "id", "left"))


def test_review_moves_texts_once(spark):
    """Neither a join with the overrides nor the handing on to equal texts sends a row with its text for each citation."""
    from citeweave.operators import review

    results = spark.createDataFrame([(k, k % 3, f"(Name {k % 5}, 2000)", "matched") for k in range(60)], "cit_id long, doc_id long, display string, outcome string")
    acts = spark.createDataFrame([(k, ("accept", "pick", "unmatch", "none")[k % 4], k % 3) for k in range(10, 60)], "cit_id long, action string, pick int")
    for df in (review.propagated(acts, results), review.unmatched(results, acts), review.tabs(results, acts)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "cit_id = cit_id" not in plan.replace("#", " #") and "MapInArrow" in plan
    first = {}
    for k in range(10, 60):
        first.setdefault((k % 3, k % 5), (("accept", "pick", "unmatch", "none")[k % 4], k % 3))
    assert {(r.cit_id, r.action, r.pick) for r in review.propagated(acts, results).collect()} == {(k, *first[k % 3, k % 5]) for k in range(60)}
    assert {r.cit_id for r in review.unmatched(results, acts).collect()} == {k for k in range(10, 60) if k % 4 == 2}


def test_titles_in_blocks(spark, monkeypatch):
    """Texts against titles of all lengths, in one block and in many, against every pair; titles are put in form once for each title, not for each item."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "été", "漢字", "a", "bb", "ccc" * 30]
    some = lambda: " ".join(rng.choices(words, k=rng.randint(1, 9)))
    titles = [some() for _ in range(60)]
    items = [(k, titles[k % 60], ["", "2000", "2001", "2002"][rng.randint(0, 3)]) for k in range(150)]
    asked = [(k, titles[k] + ", again" if k % 3 == 0 else "qqq" if k % 13 == 0 else some(), ["2000", "2001", None][k % 3]) for k in range(40)]
    order = lambda t: " ".join(sorted(t.replace(",", " ").split()))
    lib = spark.createDataFrame([(k, f"K{k}", ["A"], [], t, y) for k, t, y in items], ITEMS)
    cites = spark.createDataFrame(asked, "cit_id long, raw_text string, year string")
    for cells in (1_000_000, 2_000):
        monkeypatch.setattr(matching, "CELLS", cells)
        monkeypatch.setattr(matching, "MANY", cells)
        got = {r.cit_id: r for r in matching.title_match(cites, lib).collect()}
        assert len(got) == len(asked)
        for k, text, year in asked:
            best, first = max(((min(1.0, s * 1.15) if year and y == year else s), -n) for n, t, y in items for s in [ratio(order(text), order(t))])
            r = got[k]
            assert (round(r.score, 9), r.matched, r.lib_ord) == (round(best, 9), best >= 0.68, -first if best >= 0.68 else None), (text, year)
    texts = cites.selectExpr("raw_text AS a").distinct()
    forms = lib.selectExpr("title AS b").distinct().selectExpr("b", "array() AS years").selectExpr("b", "cast(years AS array<string>) AS years")
    assert matching.title_pairs(texts, forms).count() < texts.count() * 12  # not every pair
    assert "regexp_replace" not in matching.title_match(cites, lib)._jdf.queryExecution().optimizedPlan().toString()  # nothing is put in form for each citation


def test_block_ratios():
    """Ratios of one text with many, and their bounds, against one pair at a time."""
    import numpy as np

    from citeweave.functions.similarity import Block

    rng = random.Random(3)
    for letters, n, m in (("ab", 70, 64), ("abcdeé漢😀 xyz", 150, 130), ("abc", 300, 20)):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, m))) for _ in range(80)]
        block = Block(texts)
        for a in ["".join(rng.choices(letters + "Q", k=rng.randint(0, n))) for _ in range(8)] + ["", texts[3]]:
            got = block.ratios(a, np.arange(80))
            assert got.tolist() == [ratio(a, b) for b in texts]
            assert (block.bounds(a) >= got).all()
            assert block.ratios(a, np.array([5, 2])).tolist() == got[[5, 2]].tolist()


def test_profiles_once(spark, monkeypatch):
    """Names, years and scores of 300 numbered citations of one profile come from one stored row, not from the citations again."""
    rows = {}

    def counted(df, name, stored=matching.stored):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(matching, "stored", counted)
    cites = spark.createDataFrame([(k, 0, ["Smith"], "2000", False, "a title") for k in range(300)], CITES + ", raw_text string")
    lib = spark.createDataFrame([(k, f"K{k}", ["Smyth" if k else "Smith"], [], "a title", "2000") for k in range(3)], ITEMS)
    got = matching.numbered(cites, lib).collect()
    assert [(r.lib_ord, r.score) for r in got] == [(0, 1.0)] * 300
    assert rows["profiles"] == 1 and rows["names"] == 1


def test_reranked_between_profiles(spark, monkeypatch):
    """Every match of every citation as rerank of matches has them, without a row for each of them in an exchange."""
    rng = random.Random(8)
    words = ["ice", "sea", "birds", "of", "the", "north", "été", "rivers", "old", "maps"]
    title = lambda: " ".join(rng.choices(words, k=rng.randint(1, 6)))
    lib = [(k, f"K{k % 55}", [rng.choice(["Smith", "Smyth", "Berg"])], [], "" if k % 9 == 0 else title(), rng.choice(["2000", "2001"])) for k in range(60)]
    refs = [(k, lib[k][4] + ", again" if k < 30 else "" if k == 31 else None if k == 32 else title()) for k in range(45)]
    cites = [(k, 0, [rng.choice(["Smith", "Berg", "Zed"])], rng.choice(["2000", "2001"]), False, rng.randint(0, 50)) for k in range(400)]
    lib, refs, cites = spark.createDataFrame(lib, ITEMS), spark.createDataFrame(refs, "ref long, ref_text string"), spark.createDataFrame(cites, CITES + ", ref long")
    monkeypatch.setattr(matching, "AT_ONCE", 7)
    rows = lambda df: sorted(map(str, df.selectExpr("cit_id", "lib_ord", "item_key", "round(score, 9) AS score", "cast(rank AS int) AS rank").collect()))
    got = matching.reranked(cites, refs, lib, 82)
    plain = matching.matches(cites, lib, 82)
    want = matching.rerank(plain, cites.join(refs, "ref", "left"), lib)
    assert rows(got) == rows(want) != rows(plain) and len(rows(got)) > 2000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(cit_ids") < plan.index("RepartitionByExpression") and "Join" not in plan[: plan.index("RepartitionByExpression")]  # written out last
