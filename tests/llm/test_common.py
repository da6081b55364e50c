import os

import pytest

from tidemark.llm import common


def test_cut_tables_are_stable_and_swept(spark):
    df = common.cut(spark.range(10).selectExpr("id", "rand() AS r"), "test")
    path = common.tables()[-1]
    assert sorted(df.collect()) == sorted(df.collect())
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    common.sweep(spark, [path])
    assert not os.path.exists(local) and path not in common.tables()


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
