"""Where fitted tables go."""

import pytest
from pyspark.sql import functions as F

from rallyframe import session


def test_the_named_folder_is_used(spark, tmp_path, monkeypatch):
    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        stored = session.settle(spark.range(5))
        assert stored.inputFiles()[0].startswith(f"file://{tmp_path}")
        assert stored.count() == 5
    finally:
        if before:
            context.setCheckpointDir(before)


def test_files_hold_no_more_rows_than_asked(spark):
    """Small rows would all be in one file, which one task reads."""
    stored = session.settle(spark.range(0, 100, 1, 1), 30)
    files = stored.groupBy(F.input_file_name()).count().collect()
    assert sorted(row["count"] for row in files) == [10, 30, 30, 30]
    assert sorted(row.id for row in stored.collect()) == list(range(100))
    assert len(session.settle(spark.range(0, 100, 1, 1)).inputFiles()) == 1


def test_a_cluster_must_name_a_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
