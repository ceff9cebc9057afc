"""Reference sections: where they start, what they list, what the text leaves uncited.

Paragraphs: doc_id, para_idx (gapless from 0), para_text. Every step is a window or a join within a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import AUTHOR_YEAR_ENTRY, HEADINGS, NUMBERED_ENTRY, first_surname_key, normalize_year, strip

#: Paragraphs looked at after a heading, entries wanted among them; entries of a cluster, and others tolerated between two.
AFTER, WANTED, CLUSTER, GAP = 24, 3, 5, 3


def marked(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with `t` (stripped), `is_entry`, `is_heading`."""
    t = paragraphs.withColumn("t", strip(F.coalesce("para_text", F.lit(""))))
    return t.withColumn("is_entry", (F.col("t") != "") & F.col("t").rlike(AUTHOR_YEAR_ENTRY)).withColumn("is_heading", F.lower("t").isin(*HEADINGS))


def heading_start(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, heading_start): the last heading with enough entries soon after it."""
    ahead = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(1, AFTER)
    found = marked(paragraphs).withColumn("n", F.coalesce(F.sum(F.col("is_entry").cast("int")).over(ahead), F.lit(0)))
    return found.where(F.col("is_heading") & (F.col("n") >= WANTED)).groupBy("doc_id").agg(F.max("para_idx").alias("heading_start"))


def cluster_start(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, cluster_start, n_entries): the longest run of entries in the second half, the first of equal ones."""
    rows = marked(paragraphs).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    entries = rows.where(F.col("is_entry") & (F.col("para_idx") >= F.floor(F.col("n") / 2)))
    by_place = Window.partitionBy("doc_id").orderBy("para_idx")
    new = F.coalesce(F.col("para_idx") - F.lag("para_idx").over(by_place) > GAP + 1, F.lit(True))
    islands = entries.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(by_place))
    sizes = islands.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n_entries"), F.min("para_idx").alias("cluster_start")).where(F.col("n_entries") >= CLUSTER)
    first = Window.partitionBy("doc_id").orderBy(F.desc("n_entries"), "cluster_start")
    return sizes.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "cluster_start", "n_entries")


def sectioned(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with ref_start: by heading, else by cluster, else past the last paragraph.

    All windows are within a document, so the paragraphs are shuffled once, by doc_id, and nothing is joined back.
    """
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("para_idx")
    rows = marked(paragraphs).withColumn("n", F.count(F.lit(1)).over(doc)).withColumn("_ahead", F.coalesce(F.sum(F.col("is_entry").cast("int")).over(order.rowsBetween(1, AFTER)), F.lit(0)))
    rows = rows.withColumn("_e", F.when(F.col("is_entry") & (F.col("para_idx") >= F.floor(F.col("n") / 2)), F.col("para_idx")))
    before = F.last("_e", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("_e").isNotNull() & F.coalesce(F.col("_e") - before > GAP + 1, F.lit(True))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(order))
    island = Window.partitionBy("doc_id", "_island")
    rows = rows.withColumn("_size", F.struct(F.count("_e").over(island).alias("n"), (-F.min("_e").over(island)).alias("at")))
    heading = F.max(F.when(F.col("is_heading") & (F.col("_ahead") >= WANTED), F.col("para_idx"))).over(doc)
    largest = F.max(F.when(F.col("_size.n") >= CLUSTER, F.col("_size"))).over(doc)
    return rows.select(*paragraphs.columns, F.coalesce(heading, -largest["at"], F.col("n")).cast("long").alias("ref_start"))


def reference_start(sections: DataFrame) -> DataFrame:
    """(doc_id, ref_start) of paragraphs that sectioned() has been over."""
    return sections.groupBy("doc_id").agg(F.first("ref_start").alias("ref_start"))


def body(sections: DataFrame) -> DataFrame:
    return sections.where("para_idx < ref_start").drop("ref_start")


def _listed(sections: DataFrame) -> DataFrame:
    return sections.where("para_idx >= ref_start").select("doc_id", "para_idx", strip(F.col("para_text")).alias("t"))


def numbered_references(sections: DataFrame) -> DataFrame:
    """(doc_id, ref_num, text): the last entry of each number that has a year."""
    num = F.coalesce(F.nullif(F.regexp_extract("t", NUMBERED_ENTRY, 1), F.lit("")), F.nullif(F.regexp_extract("t", NUMBERED_ENTRY, 2), F.lit("")))
    rows = _listed(sections).select("doc_id", "para_idx", num.try_cast("int").alias("ref_num"), strip(F.regexp_extract("t", NUMBERED_ENTRY, 3)).alias("text"))
    rows = rows.where(F.col("ref_num").isNotNull() & F.col("text").rlike(r"(?U)\b\d{4}\b"))
    return rows.groupBy("doc_id", "ref_num").agg(F.max_by("text", "para_idx").alias("text"))


def author_year_references(sections: DataFrame) -> DataFrame:
    """(doc_id, surname, year, text, ord): the first entry of each surname and year."""
    rows = _listed(sections).where(F.col("t").rlike(AUTHOR_YEAR_ENTRY))
    keyed = rows.select("doc_id", "para_idx", F.col("t").alias("text"), F.lower(F.regexp_extract("t", AUTHOR_YEAR_ENTRY, 1)).alias("surname"), normalize_year(F.regexp_extract("t", AUTHOR_YEAR_ENTRY, 2)).alias("year"))
    return keyed.groupBy("doc_id", "surname", "year").agg(F.min_by("text", "para_idx").alias("text"), F.min("para_idx").alias("ord"))


def with_reference_text(citations: DataFrame, references: DataFrame) -> DataFrame:
    """citations (doc_id, authors, year, style, ...) with ref_text of their author-year reference, where they have none."""
    key = citations.withColumn("_s", first_surname_key(F.get("authors", 0))).withColumn("_y", normalize_year(F.col("year")))
    refs = references.select("doc_id", F.col("surname").alias("_s"), F.col("year").alias("_y"), F.col("text").alias("_t"))
    own = F.coalesce(F.col("ref_text"), F.lit("")) if "ref_text" in citations.columns else F.lit("")
    joined = key.join(refs, ["doc_id", "_s", "_y"], "left")
    return joined.withColumn("ref_text", F.when((own == "") & (F.col("style") == "author-year"), F.coalesce("_t", F.lit(""))).otherwise(own)).drop("_s", "_y", "_t")


def uncited(citations: DataFrame, numbers: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, kind, ord, text): references that no citation names; numbers first, then names in their order."""
    cited = citations.where("style = 'numbered' and ref_num is not null").select("doc_id", "ref_num")
    left = numbers.join(cited, ["doc_id", "ref_num"], "left_anti").select("doc_id", F.lit(0).alias("kind"), F.col("ref_num").cast("long").alias("ord"), F.concat(F.lit("["), F.col("ref_num").cast("string"), F.lit("] "), F.col("text")).alias("text"))
    named = citations.where((F.col("style") == "author-year") & (F.size("authors") > 0)).select("doc_id", first_surname_key(F.get("authors", 0)).alias("surname"), normalize_year(F.col("year")).alias("year"))
    right = names.join(named, ["doc_id", "surname", "year"], "left_anti").select("doc_id", F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"), "text")
    return left.unionByName(right)
