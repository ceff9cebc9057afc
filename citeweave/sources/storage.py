"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folders made for local applications that name none, by application.
_OWN: dict[str, str] = {}
#: Applications whose folder of intermediates goes when their driver ends.
_TO_GO: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Unset, a local application gets one of its own, as in tests; any other is told to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        context = spark.sparkContext
        master = getattr(context, "master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="citeweave-checkpoint-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        at = _OWN[app]
    return at.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; the file system drops it when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/citeweave/{app}"
    if path not in _TO_GO:
        folder, files = _files(spark, path)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _TO_GO.add(path)
    return path


def _files(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Drops what this application has stored so far; results that still read it can't be used any more."""
    path = own_folder(spark)
    folder, files = _files(spark, path)
    files.delete(folder, True)
    _TO_GO.discard(path)
