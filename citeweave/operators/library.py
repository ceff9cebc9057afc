"""The bibliographic library: items out of their relational source, collections as a tree.

Tables are those of the source: items (item_id, item_key, type_name, date_added), fields (item_id, field_name,
field_value, ord), creators (item_id, order_index, last_name, first_name, creator_role), collections (coll_id, coll_name,
parent_id, library_id, deleted), collection_items (coll_id, item_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------------
#: Kinds of items in the source and in a citation; any other is a document.
ITEM_TYPES = {
    "artwork": "graphic", "audioRecording": "song", "bill": "bill", "blogPost": "post-weblog", "book": "book", "bookSection": "chapter", "case": "legal_case",
    "computerProgram": "software", "conferencePaper": "paper-conference", "dictionaryEntry": "entry-dictionary", "document": "document", "email": "personal_communication",
    "encyclopediaArticle": "entry-encyclopedia", "film": "motion_picture", "forumPost": "post", "hearing": "hearing", "instantMessage": "personal_communication",
    "interview": "interview", "journalArticle": "article-journal", "letter": "personal_communication", "magazineArticle": "article-magazine", "manuscript": "manuscript",
    "map": "map", "newspaperArticle": "article-newspaper", "patent": "patent", "podcast": "broadcast", "preprint": "article", "presentation": "speech",
    "radioBroadcast": "broadcast", "report": "report", "statute": "legislation", "thesis": "thesis", "tvBroadcast": "broadcast", "videoRecording": "motion_picture", "webpage": "webpage",
}
#: Fields of the source and of a citation record.
ITEM_FIELDS = {
    "title": "title", "abstractNote": "abstract", "url": "URL", "accessDate": "accessed", "archive": "archive", "archiveLocation": "archive_location", "callNumber": "call-number",
    "date": "issued", "edition": "edition", "extra": "note", "ISBN": "ISBN", "ISSN": "ISSN", "issue": "issue", "journalAbbreviation": "journalAbbreviation", "language": "language",
    "DOI": "DOI", "numPages": "number-of-pages", "pages": "page", "place": "publisher-place", "publicationTitle": "container-title", "publisher": "publisher", "series": "collection-title",
    "seriesTitle": "collection-title", "seriesNumber": "collection-number", "shortTitle": "title-short", "university": "publisher", "volume": "volume", "number": "number",
    "patentNumber": "number", "reportNumber": "number", "reportType": "genre", "thesisType": "genre", "artworkSize": "dimensions", "bookTitle": "container-title", "conferenceName": "event",
    "websiteTitle": "container-title", "blogTitle": "container-title", "forumTitle": "container-title", "programTitle": "container-title", "episodeNumber": "number", "network": "publisher",
    "studio": "publisher", "label": "publisher", "distributor": "publisher", "videoRecordingFormat": "medium", "audioRecordingFormat": "medium", "medium": "medium", "runningTime": "dimensions",
    "scale": "scale", "mapType": "genre", "court": "authority", "docketNumber": "number", "firstPage": "page", "history": "references", "session": "chapter-number", "code": "container-title",
    "codeVolume": "volume", "codePages": "page", "legislativeBody": "authority", "statute": "title", "billNumber": "number", "system": "title-short", "company": "publisher",
    "programmingLanguage": "genre", "versionNumber": "version",
}
#: Kinds that aren't works.
NOT_WORKS = ("attachment", "note")
# ----------------------------------------------------------------------------------------------------------------------


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def item_type(type_name: Column) -> Column:
    return F.coalesce(_mapped(ITEM_TYPES, type_name), F.lit("document"))


def year_of(date: Column) -> Column:
    """The first four digits that stand alone, or the empty text."""
    return F.coalesce(F.regexp_extract(date, r"(?U)\b(\d{4})\b", 1), F.lit(""))


def item_uri(user_id: Column, key: Column) -> Column:
    user = F.coalesce(user_id, F.lit(""))
    return F.when(user != "", F.concat(F.lit("http://zotero.org/users/"), user, F.lit("/items/"), key)).otherwise(F.concat(F.lit("http://zotero.org/groups/0/items/"), key))


def pivoted(fields: DataFrame) -> DataFrame:
    """(item_id, fields map): the last value of each field."""
    last = fields.where("field_name is not null").groupBy("item_id", "field_name").agg(F.max_by("field_value", "ord").alias("v"))
    return last.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "v")))).alias("fields"))


def renamed_fields(fields: DataFrame) -> DataFrame:
    """(item_id, target, value): the fields of a citation record but title and date; of several with one target the first holds."""
    last = fields.groupBy("item_id", "field_name").agg(F.max_by("field_value", "ord").alias("v"), F.min("ord").alias("ord"))
    named = last.withColumn("target", _mapped(ITEM_FIELDS, F.col("field_name"))).where(F.col("target").isNotNull() & ~F.col("field_name").isin("title", "date") & (F.coalesce("v", F.lit("")) != ""))
    return named.where(~F.col("target").isin("title", "issued")).groupBy("item_id", "target").agg(F.min_by("v", "ord").alias("value"))


def creators(rows: DataFrame) -> DataFrame:
    """(item_id, authors, editors): last names, else first names, in order; other roles go, unknown ones are authors."""
    name = F.coalesce(F.nullif(F.col("last_name"), F.lit("")), F.nullif(F.col("first_name"), F.lit("")))
    named = rows.withColumn("name", name).where("name is not null").withColumn("role", F.coalesce("creator_role", F.lit("author")))
    some = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("order_index", "name")))), lambda x: x["name"])
    return named.groupBy("item_id").agg(some("author").alias("authors"), some("editor").alias("editors"))


def items(works: DataFrame, fields: DataFrame, people: DataFrame, deleted: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """The library: works that are neither deleted nor notes, in the collections `within` if given, the latest first."""
    kept = works.where(~F.col("type_name").isin(*NOT_WORKS))
    if deleted is not None:
        kept = kept.join(deleted.select("item_id"), "item_id", "left_anti")
    if within is not None:
        kept = kept.join(within.select("item_id"), "item_id", "left_semi")
    out = kept.join(pivoted(fields), "item_id", "left").join(creators(people), "item_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "item_id", "item_key", "date_added", item_type(F.col("type_name")).alias("item_type"), F.coalesce(F.col("fields")["title"], F.lit("")).alias("title"),
        year_of(F.coalesce(F.col("fields")["date"], F.lit(""))).alias("year"), F.coalesce("authors", none).alias("authors"), F.coalesce("editors", none).alias("editors"),
    )


def citation_records(library: DataFrame, fields: DataFrame) -> DataFrame:
    """(item_id, record): the JSON record of each item; keys without a value are left out."""
    more = renamed_fields(fields).groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "value")))).alias("more"))
    people = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda n: F.struct(n.alias("family"))))
    issued = F.when(F.col("year") != "", F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")))
    base = F.struct(F.col("item_id").alias("id"), F.col("item_type").alias("type"), F.nullif(F.col("title"), F.lit("")).alias("title"), people(F.col("authors")).alias("author"), people(F.col("editors")).alias("editor"), issued.alias("issued"))
    joined = library.join(more, "item_id", "left")
    both = F.when(F.col("more").isNull(), F.to_json(base)).otherwise(F.concat(F.expr("substring(to_json(base), 1, length(to_json(base)) - 1)"), F.lit(","), F.expr("substring(to_json(more), 2)")))
    return joined.withColumn("base", base).select("item_id", both.alias("record"))


def _recursive(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(text, **frames)


def collection_paths(collections: DataFrame) -> DataFrame:
    """(coll_id, path): names from the topmost live ancestor down; a circle of collections is entered at each of them and left before it repeats."""
    live = collections.where("not deleted").select("coll_id", "coll_name", "parent_id")
    text = """
    WITH RECURSIVE up(coll_id, path, next_id, seen) AS (
      SELECT coll_id, coll_name, parent_id, array(coll_id) FROM {live}
      UNION ALL
      SELECT u.coll_id, concat(l.coll_name, ' / ', u.path), l.parent_id, concat(u.seen, array(l.coll_id))
      FROM up u JOIN {live} l ON l.coll_id = u.next_id WHERE NOT array_contains(u.seen, l.coll_id))
    SELECT coll_id, max_by(path, size(seen)) AS path FROM up GROUP BY coll_id
    """
    return _recursive(collections.sparkSession, text, live=live)


def collection_list(collections: DataFrame, members: DataFrame, deleted_items: DataFrame) -> DataFrame:
    """Live collections with their path and the number of live items directly in them, by library and path."""
    counts = members.join(deleted_items.select("item_id"), "item_id", "left_anti").groupBy("coll_id").agg(F.count(F.lit(1)).alias("item_count"))
    out = collections.where("not deleted").join(collection_paths(collections), "coll_id").join(counts, "coll_id", "left")
    return out.select("coll_id", "coll_name", "parent_id", "library_id", "path", F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count")).orderBy("library_id", F.lower("path"), "coll_id")


def descendants(collections: DataFrame, root: int) -> DataFrame:
    """(coll_id): a collection and all under it, deleted ones too; an unknown one is itself. Circles end where they began."""
    text = """
    WITH RECURSIVE down(coll_id, seen) AS (
      SELECT cast({root} AS bigint), array(cast({root} AS bigint))
      UNION ALL
      SELECT c.coll_id, concat(d.seen, array(c.coll_id)) FROM down d JOIN {collections} c ON c.parent_id = d.coll_id WHERE NOT array_contains(d.seen, c.coll_id))
    SELECT DISTINCT coll_id FROM down
    """
    return collections.sparkSession.sql(text.replace("{root}", str(int(root))), collections=collections)


def within_collection(members: DataFrame, collections: DataFrame, root: int) -> DataFrame:
    """(item_id): items in a collection or any under it."""
    return members.join(descendants(collections, root), "coll_id", "left_semi").select("item_id").distinct()
