import datetime as dt

from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.operators import tasks



def test_tasks(spark):
    as_of = F.to_date(F.lit("2024-03-01"))
    none = spark.createDataFrame([], schema.TASK)
    wanted = spark.createDataFrame([("Call Ann", "next", "tomorrow", None, 1), ("call ann ", "next", None, None, 2), ("File", "odd", "+3d", "p", 3)], "name string, status string, due string, project_id string, created bigint")
    one = tasks.create_tasks(none, wanted, as_of)
    got = {r.name.lower(): r for r in one.collect()}
    assert set(got) == {"call ann", "file"} and got["file"].status == "inbox" and got["file"].due_at == dt.date(2024, 3, 4)
    assert tasks.create_tasks(one, wanted, as_of).count() == 2
    ids = {k: r.node_id for k, r in got.items()}
    moved = tasks.reschedule(one, spark.createDataFrame([(ids["file"], "none"), (ids["call ann"], "2024-05-05")], "node_id string, due string"), as_of)
    assert {r.name.lower(): r.due_at for r in moved.collect()} == {"file": None, "call ann": dt.date(2024, 5, 5)}
    done = tasks.set_status(one, spark.createDataFrame([(ids["file"], "done"), (ids["call ann"], "nonsense")], "node_id string, status string"))
    assert {r.name.lower(): r.status for r in done.collect()} == {"file": "done", "call ann": "next"}


def test_commitments(spark):
    rows = [(1, "accepted", "commitment", '{"what": "send plan", "who": "Ann", "when": "today", "direction": "owed_to_me"}'), (2, "accepted", "commitment", '{"what": "pay"}'), (3, "proposed", "commitment", '{"what": "x"}'), (4, "accepted", "commitment", "{}")]
    got = tasks.commitments(spark.createDataFrame(rows, "candidate_id bigint, status string, kind string, payload string")).collect()
    assert sorted((r.name, r.status, r.due) for r in got) == [("pay", "next", None), ("send plan", "waiting", "today")]
