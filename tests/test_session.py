"""Where stages are written."""

import time

import pytest

from storkline import session


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.stage_path(Cluster())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.stage_path(Cluster())


def test_stages_lie_in_the_given_folder_and_go_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "_stage_folder", lambda _: str(tmp_path))
    df = session.cut(spark.range(5))
    assert df.count() == 5 and list((tmp_path / "storkline").iterdir())
    session.remove_stages()
    assert not list((tmp_path / "storkline").iterdir())


def test_bucketed_stages_need_no_shuffle_and_go_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "_named", [])
    monkeypatch.setattr(session, "_stage_folder", lambda _: str(tmp_path))
    df = session.cut_by(spark.range(1000).selectExpr("id % 50 AS key", "id"), "key", 4)
    counts = df.groupBy("key").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r["count"]) for r in counts.collect()} == {(k, 20) for k in range(50)}
    (name,) = [own for _, own in session._named]
    session.remove_stages()
    assert not spark.catalog.tableExists(name) and not list((tmp_path / "storkline").iterdir())


def test_writing_a_stage_leaves_no_freed_memory_with_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "_named", [])
    monkeypatch.setattr(session, "_stage_folder", lambda _: str(tmp_path))
    answers, ask = [], session.let_go
    monkeypatch.setattr(session, "let_go", lambda s: answers.append(ask(s)))
    assert session.cut(spark.range(5)).count() == 5
    assert session.cut_by(spark.range(5), "id", 2).count() == 5
    assert len(answers) == 2 and all("Trim native heap" in a for a in answers)
    session.remove_stages()


def test_shuffles_are_let_go_only_within(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), session.shuffles_let_go(spark):
        assert spark.conf.get(key) == "true"
        raise KeyError
    assert spark.conf.get(key) == before


def test_a_written_stage_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Else they stay until the driver happens to collect its garbage."""
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "_named", [])
    monkeypatch.setattr(session, "_stage_folder", lambda _: str(tmp_path))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    df = spark.range(20_000).selectExpr("id % 1000 AS key").groupBy("key").count()
    for write in (session.cut, lambda own: session.cut_by(own, "key", 2)):
        before = shuffles()
        stage = write(df)
        for _ in range(50):
            if shuffles() <= before:
                break
            time.sleep(0.1)
        assert shuffles() <= before
        assert stage.count() == 1000
    session.remove_stages()


def test_small_tasks_never_raise_the_size(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    with session.small_tasks(spark):
        assert int(spark.conf.get(key)) == 16 << 20
    assert spark.conf.get(key) == before
    spark.conf.set(key, "3m")
    try:
        with session.small_tasks(spark):
            assert int(spark.conf.get(key)) == 3 << 20
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.set(key, before)
