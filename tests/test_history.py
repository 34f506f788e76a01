"""Snapshot differences, quarantined cells and calls in rounds."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from quillspark.operators import fees, history, rounds

SCHEMA = "k long, v string, x double"


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_replay_gives_the_new_state(spark):
    rng = random.Random(3)
    row = lambda: (rng.choice([None, 1, 2, 3, *range(10, 40)]), rng.choice(["a", "b", None]), rng.choice([0.5, None]))
    for n in (0, 1, 60):
        was, now = [row() for _ in range(n)], [row() for _ in range(rng.randrange(60))]
        now += was[: n // 2] + [(None, "hot", 1.0)] * 500
        was += [(None, "hot", 1.0)] * 700
        old, new = spark.createDataFrame(was, SCHEMA), spark.createDataFrame(now, SCHEMA)
        changes = history.difference(old, new, ["k"])
        assert rows(history.replayed(old, changes)) == Counter(now) and rows(history.replayed(new, history.backwards(changes))) == Counter(was)
        got = changes.collect()
        gone, come = Counter(was) - Counter(now), Counter(now) - Counter(was)
        assert Counter({tuple(r.before): r.times for r in got if r.before}) == gone and Counter({tuple(r.after): r.times for r in got if r.after}) == come
        by_key = lambda c: Counter(k for (k, _, _), m in c.items() for _ in range(m))
        assert {r.k for r in got if r.action == "update"} == {k for k in by_key(gone) if by_key(gone)[k] == by_key(come)[k] == 1}
        assert history.difference(old, old, ["k"]).count() == 0
    assert sorted(r.times for r in got if r.before and r.before.v == "hot") == [200]


def test_log_and_changes_that_do_not_fit(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5)], SCHEMA)
    new = spark.createDataFrame([(1, "c", 0.5), (3, "b", 0.5)], SCHEMA)
    changes = history.difference(old, new, ["k"])
    log = {r.entity_id: (r.action, r.description, r.created_at) for r in history.logged(changes, "thing", ["k"], F.lit("2024-01-01")).collect()}
    assert log == {"1": ("update", "v", "2024-01-01"), "2": ("delete", "1 rows", "2024-01-01"), "3": ("insert", "1 rows", "2024-01-01")}
    with pytest.raises(PySparkException):
        history.replayed(old.limit(0), changes).collect()


def test_good_rows_arrive_beside_wrong_cells(spark):
    schema = StructType.fromDDL("name string, cohort int, amount long")
    sources = {
        "a": spark.createDataFrame([("x", "5", "100"), ("y", "five", "1e"), ("", "6", "7"), ("z", None, " 8 "), ("x", "5", "100")], "name string, cohort string, amount string"),
        "b": spark.createDataFrame([("q", 7, 10**12)], "name string, cohort int, amount long"),
        "c": spark.createDataFrame([("lost",)], "name string"),
        "d": spark.createDataFrame([], "name string, cohort string, amount string, more string"),
    }
    good, rejects = fees.quarantined(sources, schema, required=("name",))
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, [("a", "x", 5, 100), ("a", "x", 5, 100), ("a", "z", None, 8), ("b", "q", 7, 10**12)]))
    assert good.schema.fields[1:] == schema.fields
    assert Counter((r.src, r.column, r.value, r.reason) for r in rejects.collect()) == Counter(
        [("a", "cohort", "five", "not a int"), ("a", "amount", "1e", "not a bigint"), ("a", "name", "", "missing"), ("c", "cohort", None, "no such column"), ("c", "amount", None, "no such column")]
    )
    good, rejects = fees.quarantined({"c": sources["c"]}, schema)
    assert good.count() == 0 and rejects.count() == 2 and good.columns == ["src", "name", "cohort", "amount"]


def test_a_killed_run_goes_on_with_the_attempts_left(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(i, f"m{i}") for i in range(30)], "row long, message string")

    def scorer(message, log=str(log)):
        with open(log, "a") as f:
            f.write(message + "\n")
        n = open(log).read().split("\n").count(message)
        if message == "m7" or (message == "m8" and n < 3):
            raise TimeoutError("busy")
        return message.upper()

    waits = []

    def killed(seconds):
        waits.append(seconds)
        if len(waits) == 2:
            raise KeyboardInterrupt

    args = (df, scorer, str(tmp_path / "state"))
    with pytest.raises(KeyboardInterrupt):
        rounds.score_in_rounds(*args, attempts=4, pause=0.5, batches=3, errors=(TimeoutError,), wait=killed)
    got = {r.row: r for r in rounds.score_in_rounds(*args, attempts=4, pause=0.0, batches=3, errors=(TimeoutError,), wait=waits.append).collect()}
    assert waits[:2] == [0.5, 1.0]
    calls = Counter(log.read_text().split())
    assert calls == Counter({f"m{i}": 1 for i in range(30)} | {"m7": 4, "m8": 3})
    assert (got[7].attempts, got[7].reply, got[7].error) == (4, None, "TimeoutError: busy") and (got[8].attempts, got[8].reply) == (3, "M8")
    assert all(r.attempts == 1 and r.reply == f"M{i}" for i, r in got.items() if i not in (7, 8)) and len(got) == 30


def test_other_errors_stop_the_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "m")], "row long, message string")

    def broken(message):
        raise KeyError(message)

    with pytest.raises(PySparkException):
        rounds.score_in_rounds(df, broken, str(tmp_path / "state"), pause=0.0, errors=(TimeoutError,))
    assert rounds.score_in_rounds(df.limit(0), broken, str(tmp_path / "none"), pause=0.0).count() == 0
