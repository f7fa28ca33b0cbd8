from __future__ import annotations

from types import SimpleNamespace

import pytest

from papyrine import worktable as w


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf))


def test_folder_of_the_session():
    assert w.shared_folder(session("spark://x:7077", "hdfs:///work/")) == "hdfs:///work"
    assert w.shared_folder(session("local[3]")).startswith("file:///") and w.shared_folder(session("local[3]")) == w.shared_folder(session("local[3]"))


@pytest.mark.parametrize("master", ["spark://x:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_folder(master):
    with pytest.raises(ValueError):
        w.shared_folder(session(master))


def test_table_is_written_once_and_released(spark):
    df = w.worktable(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles() and w.release(spark) >= 1
