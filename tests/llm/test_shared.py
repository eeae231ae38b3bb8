"""Where intermediate tables go, by what a session says."""

from types import SimpleNamespace

import pytest

from rolegrain.llm.shared import shared_dir


def session(**settings):
    named = {k.replace("_", "."): v for k, v in settings.items()}
    conf = SimpleNamespace(get=lambda key, default=None: named.get(key, default), set=lambda key, value: named.__setitem__(key, value))
    return SimpleNamespace(conf=conf), named


@pytest.mark.parametrize("settings, want", [
    ({"spark_checkpoint_dir": "hdfs://a/b/", "spark_master": "yarn"}, "hdfs://a/b"),
    ({"spark_master": "yarn", "spark_sql_warehouse_dir": "s3a://bucket/w/"}, "s3a://bucket/w/rolegrain-shared"),
    ({"spark_master": "yarn", "spark_sql_warehouse_dir": "file:/home/x/w"}, None),
    ({"spark_master": "spark://host:7077", "spark_sql_warehouse_dir": "/home/x/w"}, None),
    ({"spark_master": "local-cluster[3,2,1024]"}, None),
])
def test_shared_folder(settings, want):
    spark, named = session(**settings)
    if want is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(spark)
    else:
        assert shared_dir(spark) == want and named["spark.checkpoint.dir"].rstrip("/") == want


def test_one_machine_has_a_temporary_folder():
    spark, named = session(spark_master="local[4]")
    assert "rolegrain-shared-" in shared_dir(spark) and named["spark.checkpoint.dir"]
