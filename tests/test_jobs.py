"""The job stream: counts over restarts, leases, recovery and dead letters."""

import datetime as dt

from siltstone.streaming import jobs

SCHEMA = "job string, at timestamp, outcome string, total long"
START = dt.datetime(2024, 1, 1)


def write(spark, path, *made):
    rows = [(j, START + dt.timedelta(seconds=s), o, n) for j, s, o, n in made]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def now(spark, path):
    return {r.job: (r.processed, r.failed, r.state, r.attempt) for r in jobs.states(spark, path).collect()}


def test_states_go_on_after_a_restart(spark, tmp_path):
    src, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ck"))
    write(spark, src, ("a", 0, "beat", 3), ("a", 1, "done", 3), ("b", 1, "done", 2), ("b", 2, "failed", 2), ("c", 0, "beat", 1))
    jobs.run(read(spark, src), out, at)
    assert now(spark, out) == {"a": (1, 0, "running", 0), "b": (2, 1, "completed_with_errors", 0), "c": (0, 0, "queued", 0)}
    write(spark, src, ("a", 5, "done", 3), ("a", 6, "done", 3), ("c", 9, "failed", 1), ("b", 9, "beat", 2))
    jobs.run(read(spark, src), out, at)
    assert now(spark, out) == {"a": (3, 0, "completed", 0), "b": (2, 1, "completed_with_errors", 0), "c": (1, 1, "failed", 0)}
    assert spark.read.parquet(out).where("job = 'b'").count() == 1  # a sign of life changes nothing that is seen


def test_leases_requeue_and_end_in_dead_letters(spark, tmp_path):
    src, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ck"))
    go = lambda: jobs.run(read(spark, src), out, at, lease="60 seconds", attempts=1)
    write(spark, src, ("a", 0, "done", 2), ("b", 0, "done", 1), ("z", 0, "beat", 9))
    go()
    write(spark, src, ("z", 100, "beat", 9))
    go()
    got = now(spark, out)
    assert got["a"][2:] == ("requeued", 1) and got["b"][2] == "completed"
    write(spark, src, ("z", 200, "beat", 9))
    go()
    assert now(spark, out)["a"][2:] == ("dead", 2) and now(spark, out)["b"][2] == "completed" and now(spark, out)["z"][2] != "dead"
