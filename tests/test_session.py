from types import SimpleNamespace

import pytest

from riskspark import session


def fake(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: configured if key == "spark.checkpoint.dir" and configured else default),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_scratch_folder_comes_from_the_session():
    assert session.shared_dir(fake("yarn", "hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    assert session.scratch_path(fake("yarn", "hdfs://shared"), "x").startswith("hdfs://shared/riskspark/app-1/x-")


def test_cluster_without_setting_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn"))


def test_local_session_gets_one_folder():
    assert session.shared_dir(fake("local[2]")) == session.shared_dir(fake("local[2]"))


def test_written_rows_come_back(spark):
    df = spark.range(5).withColumnRenamed("id", "x")
    assert sorted(r["x"] for r in session.write_through(df, "test").collect()) == list(range(5))
