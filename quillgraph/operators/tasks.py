"""Tasks: creation, schedule and status changes, and commitments that become tasks, as deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..schema import TASK_STATUSES


def create_tasks(task: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """`task` and one for each of `wanted` (name, status, due, project_id, created); `due` is today,
    tomorrow, +Nd or a date.  An identifier is a hash of name and project, so asking twice changes nothing."""
    key = F.concat_ws("\u0001", fn.canonicalize(F.col("name")), F.coalesce("project_id", F.lit("")))
    status = F.when(F.col("status").isin(*TASK_STATUSES), F.col("status")).otherwise("inbox")
    new = wanted.select(
        F.concat(F.lit("task-"), F.substring(F.sha2(key, 256), 1, 16)).alias("node_id"), F.trim("name").alias("name"), status.alias("status"), fn.parse_due(F.col("due"), as_of).alias("due_at"), "project_id", "created"
    ).dropDuplicates(["node_id"])
    return task.unionByName(new.join(task.select("node_id"), "node_id", "left_anti").select(*task.columns))


def reschedule(task: DataFrame, change: DataFrame, as_of: Column) -> DataFrame:
    """`change` is (node_id, due): null leaves the date, ``none`` clears it, anything else sets it where it can be read."""
    c = change.select("node_id", F.lower(F.trim("due")).alias("_due"))
    read = fn.parse_due(F.col("_due"), as_of)
    due = F.when(F.col("_due").isNull(), F.col("due_at")).when(F.col("_due") == "none", F.lit(None).cast("date")).otherwise(F.coalesce(read, F.col("due_at")))
    return task.join(c, "node_id", "left").withColumn("due_at", due).select(*task.columns)


def set_status(task: DataFrame, change: DataFrame) -> DataFrame:
    """`change` is (node_id, status); a status outside the vocabulary leaves the task as it is."""
    c = change.where(F.col("status").isin(*TASK_STATUSES)).select("node_id", F.col("status").alias("_status"))
    return task.join(c, "node_id", "left").withColumn("status", F.coalesce("_status", "status")).select(*task.columns)


PROMISE = "struct<what: string, who: string, when: string, direction: string>"


def _promises(candidate: DataFrame) -> DataFrame:
    c = candidate.where("status = 'accepted' AND kind = 'commitment'").withColumn("p", F.from_json("payload", PROMISE))
    return c.where("p.what IS NOT NULL AND trim(p.what) <> ''")


def commitments(candidate: DataFrame) -> DataFrame:
    """Tasks wanted for accepted commitments: what others owe is waited for, what is owed is next.

    `candidate` has payload JSON with what, who, when and direction (``owed_to_me``, else owed by me).
    """
    status = F.when(F.col("p.direction") == "owed_to_me", "waiting").otherwise("next")
    return _promises(candidate).select(
        F.col("p.what").alias("name"), status.alias("status"), F.col("p.when").alias("due"), F.lit(None).cast("string").alias("project_id"), F.col("candidate_id").alias("created"), F.col("p.who").alias("who")
    )


def commitment_claims(candidate: DataFrame, task: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """Claims for `facts.assert_facts`: whom a task waits on, and the episode that it originated in.

    `task` is (node_id, created) of the tasks made of the candidates, `resolved` (name, node_id, label)
    of names that mean one node; nobody waits on oneself.
    """
    p = _promises(candidate).select("candidate_id", "episode_id", "p").join(task.select("node_id", F.col("created").alias("candidate_id")), "candidate_id")
    who = resolved.select(fn.canonicalize(F.col("name")).alias("_who"), F.col("node_id").alias("_node"), F.col("label").alias("_label")).dropDuplicates(["_who"])
    owed = p.where("p.direction = 'owed_to_me' AND lower(trim(p.who)) NOT IN ('', 'me')").join(who, fn.canonicalize(F.col("p.who")) == F.col("_who"))
    null, same = F.lit(None).cast("string"), [F.lit("positive").alias("polarity"), "episode_id", F.lit(0.8).alias("confidence"), F.lit("llm:commitment").alias("extractor"), at.alias("at")]
    waiting = owed.select(F.col("node_id").alias("subject_id"), F.lit("waiting_on").alias("predicate"), F.col("_node").alias("object_id"), null.alias("object_value"), F.concat(F.lit('"'), F.col("p.what"), F.lit('" is waiting on '), "_label").alias("statement"), *same)
    began = p.where("episode_id IS NOT NULL").select(
        F.col("node_id").alias("subject_id"), F.lit("originated_in").alias("predicate"), null.alias("object_id"), F.col("episode_id").cast("string").alias("object_value"),
        F.concat(F.lit('Task "'), F.col("p.what"), F.lit('" originated in episode '), F.col("episode_id").cast("string")).alias("statement"), *same,
    )
    return waiting.union(began)
