"""Sessions and the shared scratch folder, without starting another session."""

from types import SimpleNamespace

import pytest

from batchwright import session as X


def test_given_master_is_kept(spark, monkeypatch):
    assert X.configured_master() == spark.sparkContext.master
    monkeypatch.setattr(X.SparkSession, "getActiveSession", classmethod(lambda cls: None))
    monkeypatch.setattr(X, "SparkConf", lambda: {"spark.master": "yarn"})
    assert X.configured_master() == "yarn"
    asked = {}

    class Builder:
        def appName(self, name):
            return self

        def master(self, m):
            asked["master"] = m
            return self

        def getOrCreate(self):
            return SimpleNamespace(conf=SimpleNamespace(set=asked.__setitem__))

    monkeypatch.setattr(X.SparkSession, "builder", Builder())
    X.build_session(shuffle_partitions=77)
    assert "master" not in asked and asked["spark.sql.shuffle.partitions"] == "77"
    assert asked["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(256 << 20)
    X.build_session(master="spark://host:1")
    assert asked["master"] == "spark://host:1" and asked["spark.sql.shuffle.partitions"] == "20000"


@pytest.mark.parametrize("master,local", [("local", True), ("local[4]", True), ("local-cluster[3,2,1024]", False), ("yarn", False)])
def test_scratch_needs_a_shared_folder_on_a_cluster(master, local):
    made = {}
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made.get("dir"), setCheckpointDir=lambda d: made.update(dir=d))
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: default))
    if local:
        assert "/batchwright/x-" in X.scratch_path(spark, "x")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            X.scratch_path(spark, "x")
