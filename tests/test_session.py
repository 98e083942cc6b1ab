import pytest

from pinmark.session import shared_dir, spread, tune


class Settings(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, master, **settings):
        self.conf = Settings(settings)
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_is_the_configured_one():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})
    first, second = shared_dir(session, "s"), shared_dir(session, "s")
    assert first.startswith("hdfs://x/y/pinmark-s-") and first != second


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"), "s")
    assert "pinmark-s-" in shared_dir(Session("local[2]"), "s")


def test_spread_leaves_tables_with_enough_splits_alone(spark):
    few, many = spark.range(0, 100, 1, 2), spark.range(0, 100, 1, 64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many
    assert sorted(r.id for r in spread(few).collect()) == list(range(100))


def test_tuning(spark):
    assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
