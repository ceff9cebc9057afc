"""The whole way: documents and a library in, results, coded documents and a report out."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators import library as lib
from citeweave.operators import matching, references, review
from citeweave.sources import office, settings, sqlite
from citeweave.sources.storage import stored
from citeweave.streaming.documents import document_citations


@dataclass
class Analysis:
    """documents: binaryFile rows; citations and results: one row per citation; library; records: JSON per item; uncited references."""

    documents: DataFrame
    citations: DataFrame
    results: DataFrame
    library: DataFrame
    records: DataFrame
    uncited: DataFrame

    def counts(self) -> DataFrame:
        return review.status_counts(self.results)

    def status(self) -> dict:
        """What a caller that asks for the state of an analysis gets: that it is done, and its counts."""
        return {"status": "done", "counts": self.counts().first().asDict()}


def state(settings_file: Path) -> dict:
    """The paths and the collection that were used last."""
    saved = settings.load(settings_file)
    return {k: saved.get(k) for k in ("docx_path", "db_path", "collection_id")}


def collections(spark: SparkSession, path: str) -> DataFrame:
    """The collections of a library with their paths and numbers of items."""
    r = sqlite.relations(spark, path)
    return lib.collection_list(r["collections"], r["members"], r["deleted"])


def load_library(spark: SparkSession, path: str, collection: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The items of a SQLite library (those of a collection and all under it), the latest first, and their JSON records."""
    r = sqlite.relations(spark, path)
    within = lib.within_collection(r["members"], r["collections"], collection) if collection else None
    items = lib.items(r["works"], r["fields"], r["people"], r["deleted"], within)
    user = sqlite.user_id(spark, path)
    items = items.withColumn("uri", lib.item_uri(F.lit(user), F.col("item_key")))
    # The order of the library: the latest date first, then the item; one number of both, without a sort of the whole.
    date = F.coalesce(F.date_format(F.to_timestamp("date_added"), "yyyyMMddHHmmss").try_cast("long"), F.lit(0))
    order = F.concat((F.lit(10**14) - date).cast("string"), F.lpad(F.col("item_id").cast("string"), 19, "0"))
    items = items.withColumn("lib_ord", order.cast("decimal(38,0)"))
    return items, lib.citation_records(items, r["fields"])


def analyse(spark: SparkSession, documents: str, library_path: str, thresholds: matching.Thresholds = matching.Thresholds(), collection: int | None = None) -> Analysis:
    files = office.files(spark, documents)
    paragraphs = stored(office.paragraphs(files), "paragraphs")
    items, records = load_library(spark, library_path, collection)
    items = stored(items, "items")
    found = document_citations(paragraphs).withColumn("cit_id", F.xxhash64("doc_id", "in_footnote", "para_idx", "emit_ord", "num_ord"))
    cites = stored(found.withColumn("display", F.when(F.col("display_text") != "", F.col("display_text")).otherwise(F.col("raw_text"))), "citations")
    rows = paragraphs.withColumn("doc_id", F.xxhash64("path")).where("zone = 'body'").select("doc_id", "para_idx", "para_text")
    sections = stored(references.sectioned(rows), "sections")
    names = references.author_year_references(sections)
    by_name = cites.where("style = 'author-year'")
    outcome = matching.cascade(by_name, items, thresholds, names)
    by_number = cites.where("style = 'numbered'")
    hit = matching.numbered(by_number, items, thresholds)
    rest = by_number.select("cit_id").join(hit, "cit_id", "left").select("cit_id", F.when(F.col("item_key").isNull(), "unmatched").otherwise("matched").alias("outcome"), "item_key", F.coalesce("score", F.lit(0.0)).alias("confidence"))
    results = stored(cites.join(outcome.unionByName(rest, allowMissingColumns=True), "cit_id"), "results")
    results = results.withColumn("suggestion_year", F.coalesce("suggestion_year", F.lit("")))
    uncited = references.uncited(cites, references.numbered_references(sections), names)
    return Analysis(files, cites, results, items, records, uncited)


def write(analysis: Analysis, overrides: DataFrame | None = None) -> DataFrame:
    """(path, content, n_written): the documents with what the review settled as fields, one per span."""
    results = analysis.results
    none = results.select("cit_id", F.lit("").alias("action"), F.lit(0).alias("pick")).limit(0)
    settled = review.writable(review.with_overrides(results, overrides if overrides is not None else none))
    items = analysis.library.select("item_key", "item_id", "uri").join(analysis.records, "item_id", "left")
    item = F.struct(
        F.col("item_id").alias("id"), F.array("uri").alias("uris"), F.parse_json(F.col("record")).alias("itemData"), F.nullif(F.col("locator"), F.lit("")).alias("locator"),
        F.when(F.col("locator") != "", F.col("locator_label")).alias("label"), F.nullif(F.col("prefix"), F.lit("")).alias("prefix"), F.nullif(F.col("suffix"), F.lit("")).alias("suffix"),
    )
    one = settled.join(items, "item_key").withColumn("item", item)
    groups = one.groupBy("path", "doc_id", "para_idx", "char_start", "char_end").agg(F.min("raw_text").alias("raw_text"), F.transform(F.array_sort(F.collect_list(F.struct("emit_ord", "num_ord", F.to_json("item").alias("j")))), lambda x: x["j"]).alias("js"))
    text = F.to_json(F.struct(F.col("raw_text").alias("formattedCitation"), F.col("raw_text").alias("plainCitation"), F.lit(0).alias("noteIndex")))
    payload = F.concat(F.lit('{"citationID":"'), review.citation_id(F.col("doc_id"), F.col("para_idx"), F.col("char_start")), F.lit('","properties":'), text, F.lit(',"citationItems":['), F.array_join("js", ","), F.lit("]}"))
    edits = groups.select("path", "para_idx", "char_start", "char_end", F.col("raw_text").alias("text"), payload.alias("payload"))
    return office.coded(analysis.documents, edits)


def report(analysis: Analysis, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, part, ord, line): see review.report; no rows where all is matched."""
    none = analysis.results.select("cit_id", F.lit("").alias("action")).limit(0)
    rows = review.unmatched(analysis.results, overrides if overrides is not None else none)
    titles = analysis.documents.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("title"))
    return review.report(rows, analysis.uncited, titles)


def save_report(report: DataFrame, folder: str) -> None:
    """One text file per document, in a folder named by its id."""
    parts = int(report.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    report.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "part", "ord").select("doc_id", "line").write.mode("overwrite").partitionBy("doc_id").text(folder)
