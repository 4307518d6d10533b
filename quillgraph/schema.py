"""Explicit schemas and closed vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EPISODE = "episode_id bigint, source string, source_id string, body string, occurred_at timestamp_ntz, occurred_end timestamp_ntz, sensitivity string, content_hash string, meta string"
NODE = "node_id string, node_type string, name string, access_count int"
ALIAS = "node_id string, alias string"
IDENTIFIER = "node_id string, kind string, value string"
MENTION = "episode_id bigint, node_id string, extractor string, confidence double"
FACT = (
    "fact_id string, subject_id string, predicate string, object_id string, object_value string, statement string, valid_from timestamp_ntz, valid_to timestamp_ntz,"
    " ingested_at timestamp_ntz, invalidated_at timestamp_ntz, confidence double, polarity string, sensitivity string, extractor string, observations int, episode_id bigint"
)
OBSERVATION = "fact_id string, observation_id bigint, kind string, method string, episode_id bigint, observed_at timestamp_ntz, confidence double"
CANDIDATE = "candidate_id bigint, proposer string, predicate string, subject string, object_id string, object_value string, statement string, confidence double, status string, reviewed_at bigint, reject_reason string, kind string, payload string"
VERDICT = "candidate_id bigint, mechanism string, verdict string, basis string, outcome string"
TOMBSTONE = "source string, source_id string"
ANNOTATION = "episode_id bigint, kind string, body string"
VECTOR = "episode_id bigint, embedding array<float>"
CURSOR = "source string, cursor timestamp_ntz, items_seen bigint"
RAW = "episode_id bigint, content string"
CONTEXT = "node_id string, instruction string, summary string, summary_at timestamp_ntz, summary_stale boolean"
LOG = "kind string, subject string, payload string, at timestamp_ntz"
TASK = "node_id string, name string, status string, due_at date, project_id string, created bigint"
TABLES = {
    "episode": EPISODE, "nodes": NODE, "alias": ALIAS, "identifier": IDENTIFIER, "mention": MENTION, "fact": FACT, "observation": OBSERVATION, "candidate": CANDIDATE,
    "verdict": VERDICT, "tombstone": TOMBSTONE, "annotation": ANNOTATION, "vector": VECTOR, "cursor": CURSOR, "task": TASK, "raw": RAW, "context": CONTEXT, "log": LOG,
}
NODE_TYPES = ("artifact", "document", "event", "goal", "org", "person", "place", "project", "series", "task", "tool", "topic")
OBSERVATION_KINDS = ("asserted", "corrected", "corroborated", "disputed", "verified")
TASK_STATUSES = ("done", "inbox", "next", "scheduled", "someday", "waiting")
RUNGS = ("staged", "sampled", "trusted")


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def violations(nodes: DataFrame, observation: DataFrame) -> DataFrame:
    """(table, key, value) of rows outside a closed vocabulary."""
    from pyspark.sql import functions as F

    bad_nodes = nodes.where(~F.col("node_type").isin(*NODE_TYPES)).select(F.lit("nodes").alias("table"), F.col("node_id").alias("key"), F.col("node_type").alias("value"))
    bad = observation.where(~F.col("kind").isin(*OBSERVATION_KINDS)).select(F.lit("observation"), F.col("fact_id"), F.col("kind"))
    return bad_nodes.union(bad)


#: What each version added to the tables of the one before: (table, column, type, value of old rows).
MIGRATIONS: tuple[tuple[tuple[str, str, str, str], ...], ...] = (
    (("fact", "object_value", "string", "CAST(NULL AS STRING)"), ("fact", "polarity", "string", "'positive'"), ("fact", "sensitivity", "string", "'personal'")),
    (("candidate", "object_id", "string", "CAST(NULL AS STRING)"), ("candidate", "object_value", "string", "CAST(NULL AS STRING)"), ("candidate", "reject_reason", "string", "CAST(NULL AS STRING)")),
    (("nodes", "access_count", "int", "0"), ("episode", "meta", "string", "CAST(NULL AS STRING)")),
)


def migrate(tables: dict[str, DataFrame], version: int = 0) -> tuple[dict[str, DataFrame], int]:
    """(tables of the newest version, its number): missing tables are empty, missing columns have their old rows' value."""
    from pyspark.sql import functions as F

    spark = next(iter(tables.values())).sparkSession
    out = dict(tables)
    for step in MIGRATIONS[version:]:
        for name, column, kind, value in step:
            if name in out and column not in out[name].columns:
                out[name] = out[name].withColumn(column, F.expr(value).cast(kind))
    for name, columns in TABLES.items():
        wanted = [c.split()[0] for c in columns.replace("array<struct<", "array<").split(", ")]
        out[name] = out[name].select(*wanted) if name in out else spark.createDataFrame([], columns)
    return out, len(MIGRATIONS)
