from types import SimpleNamespace

import pytest

from quillstore import shared


def _session(conf=None, checkpoint=None, master="spark://host:7077"):
    known = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf or default), sparkContext=context)


def test_where_the_shared_folder_is():
    assert shared.shared_dir(_session(conf="hdfs://n/c/")) == "hdfs://n/c"
    assert shared.shared_dir(_session(checkpoint="hdfs://n/d")) == "hdfs://n/d"
    assert shared.shared_dir(_session(master="local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(shared.NoSharedFolder):
            shared.shared_dir(_session(master=master))


def test_the_session_of_the_tests_names_one(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_folder_is_removed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    shared.remove(spark, path)
    assert not (tmp_path / "t").exists()
    shared.remove(spark, path)
