"""Review of results: counts, overrides, tabs, what is written and what is reported.

Results: the cascade's rows joined with their citation (doc_id, index, display, ...). Overrides: cit_id, action (accept,
pick, unmatch), pick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.operators.matching import Resolved
from citeweave.operators.packed import met
from citeweave.sources.storage import stored

TABS = ("ambiguous", "suggestion", "unmatched", "matched")


def status_counts(results: DataFrame) -> DataFrame:
    """One row: matched, ambiguous, suggestions and the rest, which holds the last resorts."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    kinds = [n("matched").alias("matched"), n("ambiguous").alias("ambiguous"), n("suggestion").alias("suggestions")]
    return results.agg(*kinds, F.count(F.lit(1)).alias("total")).withColumn("unmatched", F.col("total") - F.col("matched") - F.col("ambiguous") - F.col("suggestions"))


def first_by_display(results: DataFrame) -> DataFrame:
    """The first row of each display text of a document."""
    w = Window.partitionBy("doc_id", "display").orderBy("cit_id")
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def propagated(overrides: DataFrame, results: DataFrame) -> DataFrame:
    """overrides for every row with the display text of an overridden one; of several actions the one on the first row holds."""
    said = results.select("cit_id", "doc_id", "display")
    acted = met(said, overrides.select("cit_id", "action", "pick"), "cit_id", "inner")
    one = acted.groupBy("doc_id", "display").agg(F.min_by(F.struct("action", "pick"), "cit_id").alias("o"))
    same = said.groupBy("doc_id", "display").agg(F.collect_list("cit_id").alias("cit_ids"))  # the text goes once with all that share it
    return same.join(one, ["doc_id", "display"]).select(F.explode("cit_ids").alias("cit_id"), "o.action", "o.pick")


def with_overrides(results: DataFrame, overrides: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """results after review: taken back first, then a picked candidate (one that exists), an accepted suggestion, else as they were.

    The candidates are a column of results, or, where these have a profile instead, candidates (profile, candidates); then
    only the ones at places that were picked meet the results.
    """
    r = met(results, overrides.where("action in ('accept', 'pick', 'unmatch')").select("cit_id", "action", "pick"), "cit_id")
    undone = F.coalesce(F.col("action") == "unmatch", F.lit(False))
    if candidates is None:
        picked = F.get("candidates", F.col("pick"))
    else:
        asked = overrides.where("action = 'pick'").select("pick").distinct()
        one = stored(candidates.select("profile", F.posexplode("candidates").alias("pick", "_choice")).join(asked, "pick", "left_semi"), "picks")
        r, picked = r.join(one, ["profile", "pick"], "left"), F.col("_choice")
    choice = F.when(F.col("action") == "pick", picked)
    outcome = F.when(undone, "unmatched").when(choice.isNotNull(), "matched").otherwise(F.col("outcome"))
    return r.select(
        *[c for c in results.columns if c not in ("outcome", "item_key", "confidence")],
        outcome.alias("outcome"),
        F.when(~undone, F.coalesce(choice["item_key"], F.col("item_key"))).alias("item_key"),
        F.when(undone, 0.0).otherwise(F.coalesce(choice["score"], F.col("confidence"))).alias("confidence"),
        (~undone & (F.coalesce(F.col("action") == "accept", F.lit(False))) & (F.col("outcome") == "suggestion")).alias("accepted"),
    )


def writable(reviewed: DataFrame) -> DataFrame:
    """Rows that go into the document: matched or accepted, and not in a footnote."""
    return reviewed.where(((F.col("outcome") == "matched") | F.col("accepted")) & ~F.col("in_footnote"))


def effective_count(reviewed: DataFrame) -> DataFrame:
    """How many citations count as replaced; those in footnotes do, though they aren't written."""
    return reviewed.agg(F.count_if((F.col("outcome") == "matched") | F.col("accepted")).alias("replaced"))


def unmatched(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows that no match, accepted suggestion or picked candidate settles."""
    r = met(results, overrides.where("action in ('accept', 'pick', 'unmatch')").select("cit_id", "action"), "cit_id").withColumn("action", F.coalesce("action", F.lit("")))
    settled = ((F.col("outcome") == "matched") & (F.col("action") != "unmatch")) | ((F.col("outcome") == "suggestion") & (F.col("action") == "accept")) | ((F.col("outcome") == "ambiguous") & (F.col("action") == "pick"))
    return r.where(~settled).drop("action")


def span_groups(rows: DataFrame) -> DataFrame:
    """(doc_id, para_idx, char_start, char_end, cit_ids, group_ord): citations that share a span of text, in the order they are written: paragraphs up, spans down."""
    g = rows.groupBy("doc_id", "para_idx", "char_start", "char_end").agg(F.array_sort(F.collect_list("cit_id")).alias("cit_ids"))
    return g.withColumn("group_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", F.desc("char_start"))))


def tabs(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """(cit_id, tab): the tab of each row."""
    r = met(results.select("cit_id", "outcome"), overrides.where("action in ('accept', 'pick', 'unmatch')").select("cit_id", "action"), "cit_id")
    return r.select("cit_id", tab(F.col("outcome"), F.col("action")).alias("tab"))


def tab(outcome: Column, action: Column) -> Column:
    """The tab of the review screen that shows a row."""
    a = F.coalesce(action, F.lit(""))
    return (
        F.when(a == "unmatch", "unmatched")
        .when((outcome == "suggestion") & (a == "accept"), "matched")
        .when((outcome == "ambiguous") & (a == "pick"), "matched")
        .when(outcome.isin("matched", "ambiguous", "suggestion"), outcome)
        .otherwise("unmatched")
    )


def served(answers: DataFrame, library: DataFrame) -> DataFrame:
    """Answers or results as api_rows serves them, without what it takes from the citation."""
    items = library.select("item_key", F.substring("title", 1, 80).alias("item_title"), F.col("year").alias("item_year"), F.slice("authors", 1, 3).alias("item_authors"))
    top = F.transform(F.slice("candidates", 1, 5), lambda c: F.struct(c["item_key"].alias("key"), F.bround(c["score"] * 100).cast("int").alias("confidence")))
    none = F.array().cast("array<string>")
    out = answers.withColumn("candidates", top).withColumn("confidence", F.bround(F.col("confidence") * 100).cast("int")).join(items, "item_key", "left")
    return out.withColumn("item_key", F.coalesce("item_key", F.lit(""))).withColumn("item_title", F.coalesce("item_title", F.lit(""))).withColumn("item_year", F.coalesce("item_year", F.lit(""))).withColumn("item_authors", F.coalesce("item_authors", none))


def api_rows(results: DataFrame | Resolved, library: DataFrame) -> DataFrame:
    """Rows as they are served: titles cut to 80 letters, three authors, five candidates, whole percents (halves to even). Of what is resolved by profile, items and candidates are looked up once for each profile."""
    if isinstance(results, Resolved):
        return results.rows(stored(served(results.answers.join(results.candidates, "profile"), library), "served"))
    return served(results, library)


def report_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, line): one line for each display text that is still unmatched, with its place, suggestion and reference."""
    first = first_by_display(rows)
    place = F.when(F.col("in_footnote"), "footnote").otherwise(F.concat(F.lit("para "), (F.col("para_idx") + 1).cast("string")))
    hint = F.when(F.col("outcome") == "suggestion", F.concat(F.lit("  [suggestion: "), F.col("item_key"), F.lit(" ("), F.col("suggestion_year"), F.lit(")]"))).otherwise("")
    text = F.when(F.coalesce("ref_text", F.lit("")) != "", F.concat(F.lit("\n    → "), F.col("ref_text"))).otherwise("")
    return first.select("doc_id", F.col("cit_id").alias("ord"), F.concat(F.col("display"), F.lit("  ["), place, F.lit("]"), hint, text).alias("line"))


def report(rows: DataFrame, uncited: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, part, ord, line): the whole report of each document that has anything unmatched, in order of part and ord.

    rows: what unmatched() gives; uncited: references.uncited(); titles: (doc_id, title), what the documents are called.
    """
    lines = stored(report_lines(rows), "lines")
    count = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    block = lambda df, part, *texts: df.select("doc_id", F.lit(part).alias("part"), F.posexplode(F.array(*texts)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    spaced = lambda df, part, c: df.select("doc_id", F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.col(c), F.lit("\n")).alias("line"))
    found = count(lines)
    head = block(found.join(titles, "doc_id"), 0, F.concat(F.lit("Unmatched citations from: "), F.col("title")), F.concat(F.lit("Total unmatched: "), F.col("n")), F.lit(""))
    rest = uncited.join(found.select("doc_id"), "doc_id", "left_semi").withColumn("ord", F.col("kind") * 1_000_000_000 + F.col("ord"))
    middle = block(count(rest), 2, F.lit(""), F.lit("=" * 60), F.concat(F.lit("References listed but not cited in text: "), F.col("n")), F.lit(""))
    return head.unionByName(spaced(lines, 1, "line")).unionByName(middle).unionByName(spaced(rest, 3, "text"))


def summaries(results: DataFrame | Resolved, library: DataFrame) -> DataFrame:
    """(cit_id, summary): one line per result for people to read. Of what is resolved by profile, items are looked up once for each profile."""
    items = library.select("item_key", "authors", F.col("year").alias("item_year"), F.coalesce("title", F.lit("")).alias("title"))
    if isinstance(results, Resolved):
        of_items = stored(results.answers.join(items, "item_key", "left"), "of-items")
        r = Resolved(results.citations.select("cit_id", "profile", "display", "year"), results.answers, results.candidates).rows(of_items)
    else:
        r = results.join(items, "item_key", "left")
    names = lambda n: F.array_join(F.slice("authors", 1, n), "; ")
    item = lambda people, n: F.concat(F.col("display"), F.lit(" → ["), F.col("item_key"), F.lit("] "), people, F.lit(" ("), F.col("item_year"), F.lit(") — "), F.substring("title", 1, n), F.lit("… ("))
    near = F.concat(F.lit("? "), item(names(2), 50), F.lit("year differs: doc="), F.col("year"), F.lit(", lib="), F.col("item_year"), F.lit(")"))
    many = F.when(F.size("authors") > 3, F.concat(names(3), F.lit(" et al."))).otherwise(names(3))
    match = F.concat(F.lit("✓ "), item(many, 60), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)"))
    none = F.concat(F.lit("✗ "), F.col("display"), F.lit(" — no match found"))
    return r.select("cit_id", F.when(F.col("outcome") == "suggestion", near).when(F.col("outcome") == "matched", match).otherwise(none).alias("summary"))


def citation_id(*parts: Column) -> Column:
    """Eight characters out of what identifies a citation, the same in every run."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8)


def citation_json(groups: DataFrame) -> DataFrame:
    """groups (doc_id, para_idx, char_start, raw_text, items array<struct<id, uris, locator, label, prefix, suffix>>) with field_json: the payload of a field code."""
    text = F.col("raw_text")
    props = F.struct(text.alias("formattedCitation"), text.alias("plainCitation"), F.lit(0).alias("noteIndex"))
    return groups.withColumn("field_json", F.to_json(F.struct(citation_id(F.col("doc_id"), F.col("para_idx"), F.col("char_start")).alias("citationID"), props.alias("properties"), F.col("items").alias("citationItems"))))
