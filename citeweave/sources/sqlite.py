"""A SQLite library as Spark tables: a Python data source, and the source's relations in the form that operators take."""

from __future__ import annotations

import os
import shutil
import sqlite3
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from citeweave.operators.library import NOT_WORKS
from citeweave.sources.storage import own_folder

TYPES = {"INT": "long", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
ROWS = 100_000
FROZEN = ".frozen"


@contextmanager
def snapshot(path: str) -> Iterator[sqlite3.Connection]:
    """A connection to a copy of the file, so a program that holds it locked isn't met."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    with tempfile.TemporaryDirectory() as folder:
        copy = shutil.copy(path, folder)
        with closing(sqlite3.connect(copy)) as con:
            yield con


def frozen(spark: SparkSession, path: str) -> str:
    """One copy of the file for all its relations, in the shared folder where that is a mounted one; else the path itself, which each partition copies."""
    folder = own_folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder or not Path(path).exists():
        return path
    Path(folder).mkdir(parents=True, exist_ok=True)
    return shutil.copy(path, f"{folder}/library-{uuid.uuid4().hex}{FROZEN}")


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    """Read-only to a copy made by frozen(), else to a copy made now."""
    if path.endswith(FROZEN):
        with closing(sqlite3.connect(f"{Path(path).absolute().as_uri()}?immutable=1", uri=True)) as con:
            yield con
    else:
        with snapshot(path) as con:
            yield con


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, table, columns

    def partitions(self) -> list[Rows]:
        with opened(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [Rows(k, k + ROWS) for k in range(low, high + 1, ROWS)] if low is not None else [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with opened(self.path) as con:
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("table", name).load(); rows are dealt by ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with opened(self.options["path"]) as con:
            columns = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kind = lambda t: next((v for k, v in TYPES.items() if k in t.upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.fieldNames())


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", name).load()


def user_id(spark: SparkSession, path: str) -> str:
    """Of the account, else the first user library, else "0"."""
    settings = table(spark, path, "settings").where("setting = 'account' and `key` = 'userID'").select("value").limit(1).collect()
    if settings and settings[0][0]:
        return str(settings[0][0])
    own = table(spark, path, "libraries").where("type = 'user'").agg(F.min("libraryID")).first()[0]
    return str(own) if own is not None else "0"


def relations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """works, fields, people, deleted, collections, members: the library's relations in one state, as citeweave.operators.library takes them."""
    path = frozen(spark, path)
    t = lambda name: table(spark, path, name)
    works = t("items").join(F.broadcast(t("itemTypes")), "itemTypeID").where(~F.col("typeName").isin(*NOT_WORKS))
    values = t("itemData").join(F.broadcast(t("fields")), "fieldID").join(t("itemDataValues"), "valueID")
    people = t("itemCreators").join(t("creators"), "creatorID").join(F.broadcast(t("creatorTypes")), "creatorTypeID", "left")
    gone = t("deletedCollections").select("collectionID", F.lit(True).alias("deleted"))
    collections = t("collections").join(gone, "collectionID", "left")
    return {
        "works": works.select(F.col("itemID").alias("item_id"), F.col("key").alias("item_key"), F.col("typeName").alias("type_name"), F.col("dateAdded").alias("date_added"), F.col("libraryID").alias("library_id")),
        "fields": values.select(F.col("itemID").alias("item_id"), F.col("fieldName").alias("field_name"), F.col("value").alias("field_value"), F.col("fieldID").alias("ord")),
        "people": people.select(F.col("itemID").alias("item_id"), F.col("orderIndex").alias("order_index"), F.col("lastName").alias("last_name"), F.col("firstName").alias("first_name"), F.col("creatorType").alias("creator_role")),
        "deleted": t("deletedItems").select(F.col("itemID").alias("item_id")),
        "collections": collections.select(F.col("collectionID").alias("coll_id"), F.col("collectionName").alias("coll_name"), F.col("parentCollectionID").alias("parent_id"), F.col("libraryID").alias("library_id"), F.coalesce("deleted", F.lit(False)).alias("deleted")),
        "members": t("collectionItems").select(F.col("collectionID").alias("coll_id"), F.col("itemID").alias("item_id")),
    }


def default_file(name: str, home: Path | None = None) -> Path | None:
    """The first of the usual places that holds a library of this file name."""
    home = home or Path.home()
    folders = [home / "Zotero", home / "snap" / "zotero-snap" / "common" / "Zotero", home / ".zotero"]
    if sys.platform.startswith("win") and (roaming := os.environ.get("APPDATA")):
        folders.append(Path(roaming) / "Zotero")
    return next((f / name for f in folders if (f / name).exists()), None)
