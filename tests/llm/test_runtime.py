"""Shared storage: where it must be named, and that intermediate tables can be removed."""

import os

import pytest

from textloom.llm import runtime


class Session:
    """As much of a cluster's session as is asked here."""

    def __init__(self, master):
        self.conf, self.sparkContext = {}, type("Context", (), {"master": master})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_its_folder(master):
    session = Session(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_root(session)
    session.conf["spark.checkpoint.dir"] = "s3://bucket/x/"
    assert runtime.shared_root(session) == "s3://bucket/x"


def test_tables_are_removed(spark):
    kept, gone = (runtime.materialize(spark.range(5), name) for name in ("kept", "gone"))
    paths = [df._textloom_path.removeprefix("file://") for df in (kept, gone)]
    runtime.discard(gone, None, spark.range(1))
    assert [os.path.exists(p) for p in paths] == [True, False] and kept.count() == 5
    written, runtime._written[:] = list(runtime._written), [kept._textloom_path]
    runtime.clean_up(spark)
    runtime._written[:] = [p for p in written if p != kept._textloom_path]
    assert not os.path.exists(paths[0])


def test_sorted_lookup():
    import numpy as np

    table = np.sort(np.array([5, -3, 2**62, -(2**63)], np.int64))
    h = np.array([5, 6, -3, 2**62, -(2**63), 0], np.int64).view(np.uint64)
    assert runtime.sorted_lookup(table)(h).tolist() == [0, 2, 3, 4] and runtime.sorted_lookup(table[:0])(h).tolist() == []
