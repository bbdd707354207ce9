from __future__ import annotations

from types import SimpleNamespace

import pytest

from qaloom import session


def fake(master, configured=None, application="app-1"):
    context = SimpleNamespace(master=master, applicationId=application)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: configured or default), sparkContext=context)


def test_scratch_is_what_the_cluster_names():
    assert session.scratch_root(fake("spark://host:7077", "hdfs:///shared/scratch/")) == "hdfs:///shared/scratch"


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(fake("yarn"))


def test_a_local_session_keeps_one_folder():
    first = session.scratch_root(fake("local[2]", application="app-a"))
    assert first == session.scratch_root(fake("local[2]", application="app-a"))
    assert first != session.scratch_root(fake("local[2]", application="app-b"))


def test_measure_reads_no_bytes_past_the_bound(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 10)
    assert session.measure(spark.range(1000)) == (1000, session.BROADCAST_MAX_BYTES + 1)
    assert not session.is_small(spark.range(11)) and session.is_small(spark.range(10))
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 5)
    assert not session.is_small(spark.range(10))


def test_stage_keeps_rows_and_types(spark):
    frame = spark.sql("SELECT id, named_struct('a', id) AS s, array('x') AS l FROM range(5)")
    staged = session.stage(frame, "probe")
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, frame.collect()))
    assert staged.inputFiles()


def test_stages_go_at_the_end_of_their_scope(spark):
    import os

    root = session.scratch_root(spark)
    before = set(os.listdir(root))
    with session.stages(spark):
        staged = session.stage(spark.range(10), "scoped")
        assert staged.count() == 10 and set(os.listdir(root)) - before
    assert set(os.listdir(root)) == before


def test_a_path_of_the_caller_is_not_overwritten(spark, tmp_path):
    session.stage(spark.range(3), "own", str(tmp_path / "own"))
    with pytest.raises(Exception, match="already exists"):
        session.stage(spark.range(4), "own", str(tmp_path / "own"))
    with session.stages(spark):
        pass
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3
