"""Versioned tables: concurrent builders, readers between, builders that die."""

import threading

import pytest

from cellcube.sources import commits
from cellcube.sources import tabular as TB


def _table(spark, n):
    return spark.range(n).withColumnRenamed("id", "pixel_idx")


def test_a_number_is_put_once(spark):
    path = TB.scratch_path(spark, "put") + "/commits/000000000001"
    won, gate = [], threading.Barrier(8)

    def go(i):
        gate.wait()
        if commits.put_if_absent(spark, path, f"writer {i}"):
            won.append(i)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and commits._read(spark, path) == f"writer {won[0]}"
    assert list(commits._names(spark, path.rsplit("/", 1)[0])) == ["000000000001"]       # no leavings


def test_two_builders_and_a_reader(spark):
    path = TB.scratch_path(spark, "race")
    gate, results, seen, stop = threading.Barrier(2), [], [], threading.Event()

    def build():
        gate.wait()                     # both have found no table
        return _table(spark, 5000)

    def builder():
        results.append(TB.materialize_if_absent(spark, build, path, ["pixel_idx"]).count())

    def reader():
        while not stop.is_set():
            state = commits.current(spark, path)
            seen.append(spark.read.parquet(state.path).count() if state else None)

    threads = [threading.Thread(target=f) for f in (builder, builder)]
    watch = threading.Thread(target=reader)
    watch.start()
    [t.start() for t in threads]
    [t.join() for t in threads]
    stop.set()
    watch.join()
    assert results == [5000, 5000] and set(seen) <= {None, 5000}
    assert commits.current(spark, path).number == 1
    assert len(commits._names(spark, f"{path}/versions")) == 1      # the second builder dropped its own


@pytest.mark.parametrize("step", ["while writing", "before the commit"])
def test_a_builder_that_dies_leaves_no_table(spark, step, monkeypatch):
    path = TB.scratch_path(spark, "killed")

    class Killed(BaseException):
        pass

    def die(*_, **__):
        raise Killed

    with monkeypatch.context() as m:
        if step == "before the commit":
            m.setattr(commits, "publish", die)
        with pytest.raises(Killed):
            TB.materialize_if_absent(spark, die if step == "while writing" else lambda: _table(spark, 3), path, ["pixel_idx"])
    assert commits.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        commits.read(spark, path)
    assert TB.materialize_if_absent(spark, lambda: _table(spark, 9), path, ["pixel_idx"]).count() == 9
    assert commits.clean(spark, path, older_than=0) == (step == "before the commit")
    assert commits.read(spark, path).count() == 9


def test_missing_column_commits_after_the_other_builder(spark):
    path = TB.scratch_path(spark, "columns")
    TB.materialize_if_absent(spark, lambda: _table(spark, 4), path, ["pixel_idx"])
    old = commits.read(spark, path)
    both = TB.materialize_if_absent(spark, lambda: _table(spark, 4).selectExpr("pixel_idx", "1 AS twi"), path, ["pixel_idx", "twi"])
    assert set(both.columns) == {"pixel_idx", "twi"} and commits.current(spark, path).number == 2
    assert old.count() == 4                                         # a reader of the older version is not disturbed


def test_replace_builds_on_the_other_writers_state(spark):
    path = TB.scratch_path(spark, "replace")
    states = []

    def add(state, folder):
        states.append(state.number if state else 0)
        before = state.notes["rows"] if state else 0
        if len(states) == 1:            # another writer commits while this one builds
            commits.replace(spark, path, add)
        _table(spark, before + 1).write.parquet(folder)
        return {"rows": before + 1}

    commits.replace(spark, path, add)
    assert states == [0, 0, 1] and commits.read(spark, path).count() == 2
    assert commits.clean(spark, path, older_than=3600) == 0
    assert commits.clean(spark, path, older_than=0) == 1 and commits.read(spark, path).count() == 2
