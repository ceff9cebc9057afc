"""Documents as they arrive: a file stream whose batches give paragraphs and their citations.

Paragraphs need nothing but their own file, so that part is a stateless map on the stream. Reference sections are windows
over a whole document, which a file always brings at once; they run in foreachBatch, with the same plan as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeweave.operators import references, tokenise
from citeweave.sources import office

FILES = "path string, modificationTime timestamp, length long, content binary"


def paragraph_stream(spark: SparkSession, folder: str) -> DataFrame:
    return office.paragraphs(spark.readStream.format("binaryFile").schema(FILES).load(folder))


def document_citations(paragraphs: DataFrame) -> DataFrame:
    """Citations of paragraphs (path, zone, para_idx, para_text): the body's before the list of references, then those of notes."""
    rows = paragraphs.withColumn("doc_id", F.xxhash64("path"))
    body = rows.where("zone = 'body'").select("doc_id", "para_idx", "para_text")
    sections = references.sectioned(body)
    numbers, names = references.numbered_references(sections), references.author_year_references(sections)
    found = tokenise.citations(references.body(sections), numbers)
    notes = tokenise.citations(rows.where("zone = 'note'").select("doc_id", "para_idx", "para_text"), numbers, in_footnote=True)
    paths = rows.select("doc_id", "path").distinct()
    return references.with_reference_text(found.unionByName(notes), names).join(paths, "doc_id")


def citation_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the citations of each new document to `out`, one folder per batch, so a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        document_citations(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return paragraph_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
