from types import SimpleNamespace

import pytest

from citeweave.sources import storage


def test_setting_of_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5)
    assert storage.stored(df, "numbers").count() == 5 and storage.stored(df.limit(0), "none").dtypes == df.dtypes


def test_unset():
    none = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, applicationId="test-app"))
    assert storage.shared_dir(session) == storage.shared_dir(session) != ""


def test_a_cluster_has_to_name_a_folder():
    none = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, applicationId="far-app", master="spark://host:7077"))
    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(session)


def test_forget(spark):
    from pathlib import Path

    storage.stored(spark.range(3), "numbers")
    folder = Path(storage.own_folder(spark))
    assert any(folder.iterdir())
    storage.forget(spark)
    assert not folder.exists()
    assert storage.stored(spark.range(3), "numbers").count() == 3
