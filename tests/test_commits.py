"""Loads of several tables: all or nothing, and one of two writers wins."""

import threading

import pytest
from pyspark.errors import PySparkException

from quillspark.sources import commits, sinks


def values(spark, root, name, at=None):
    return sorted(r.v for r in commits.read(spark, root, name, at).collect())


def frame(spark, *vs):
    return spark.createDataFrame([(v,) for v in vs], "v long")


def test_a_killed_load_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert commits.state(spark, root) == commits.State(0, {}, ())
    first = commits.commit(spark, root, {"a": frame(spark, 1), "b": frame(spark, 2)}, commits.state(spark, root))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "_published", killed)
    with pytest.raises(KeyboardInterrupt):
        commits.commit(spark, root, {"a": frame(spark, 9), "b": frame(spark, 9)}, first)
    monkeypatch.undo()
    assert commits.state(spark, root) == first and values(spark, root, "a") == [1] and values(spark, root, "b") == [2]
    left = commits.leftovers(spark, root)
    assert len(left) == 2
    # A load that is half written is gone as well.
    broken = frame(spark, 1).selectExpr("raise_error('lost') AS v")
    with pytest.raises(PySparkException):
        commits.commit(spark, root, {"b": frame(spark, 7), "a": broken}, first)
    assert values(spark, root, "b") == [2]
    assert commits.swept(spark, root, [*left, first.folders["a"]]) == 2 and values(spark, root, "a") == [1]
    second = commits.commit(spark, root, {"b": frame(spark, 3)}, first)
    assert (values(spark, root, "a"), values(spark, root, "b")) == ([1], [3]) and values(spark, root, "b", first) == [2] and second.number == 2
    with pytest.raises(KeyError):
        commits.read(spark, root, "c")


def test_two_writers_of_one_state(spark, tmp_path):
    root = str(tmp_path / "store")
    base = commits.commit(spark, root, {"a": frame(spark, 1), "b": frame(spark, 1), "c": frame(spark, 1)}, commits.state(spark, root))
    outcome = {}

    def load(n):
        try:
            outcome[n] = commits.commit(spark, root, {"a": frame(spark, n), f"own{n}": frame(spark, n)}, base)
        except commits.ConflictError as e:
            outcome[n] = e

    threads = [threading.Thread(target=load, args=(n,)) for n in (10, 11, 12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, x in outcome.items() if isinstance(x, commits.State)]
    assert len(won) == 1 and values(spark, root, "a") == won and values(spark, root, f"own{won[0]}") == won
    # Others that touch no common table go on top; what was read counts as well.
    assert commits.commit(spark, root, {"b": frame(spark, 5)}, base).number == 3
    with pytest.raises(commits.ConflictError):
        commits.commit(spark, root, {"c": frame(spark, 6)}, base, reads=("a",))
    assert (values(spark, root, "b"), values(spark, root, "c")) == ([5], [1])


def test_a_manifest_is_never_replaced(spark, tmp_path):
    root = str(tmp_path / "store")
    made = commits.commit(spark, root, {"a": frame(spark, 1)}, commits.state(spark, root))
    assert not commits._published(spark, root, made._replace(folders={}))
    assert commits.state(spark, root) == made


def test_snapshots_are_immutable(spark, tmp_path):
    sinks.write_snapshot(frame(spark, 1), str(tmp_path / "s"), "1")
    with pytest.raises(PySparkException):
        sinks.write_snapshot(frame(spark, 2), str(tmp_path / "s"), "1")
    assert [r.v for r in sinks.read_snapshot(spark, str(tmp_path / "s"), "1").collect()] == [1]
