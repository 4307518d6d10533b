"""Single calls on a graph's tables, as a front end makes them: each returns a table or the tables that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import facts, graph, ingest, resolve, triage
from ..session import written
from .ingestion import ingest_run


def resolved_names(spark: SparkSession, tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(subject, node_id, label) of the names that mean one node."""
    wanted = spark.createDataFrame([(n, n) for n in dict.fromkeys(names)], "query_id string, name string")
    one = resolve.resolve_unique(resolve.resolve_all(wanted, tables["nodes"], tables["alias"], tables["identifier"]))
    return one.join(tables["nodes"].select("node_id", F.col("name").alias("label")), "node_id").select(F.col("query_id").alias("subject"), "node_id", "label")


def upsert_fact(tables: dict[str, DataFrame], claim: dict, at: Column, polarity: str = "positive") -> dict[str, DataFrame]:
    """The tables after a claim {subject, predicate, object, statement, confidence} by names.

    An object that isn't one node is a literal; a subject that isn't one adds nothing.
    """
    spark = tables["fact"].sparkSession
    names = resolved_names(spark, tables, [x for x in (claim["subject"], claim.get("object")) if x])
    row = spark.createDataFrame([(claim["subject"], claim["predicate"], claim.get("object"), claim["statement"], float(claim.get("confidence", 0.9)))], "subject string, predicate string, object string, statement string, confidence double")
    subject = names.select("subject", F.col("node_id").alias("subject_id"))
    object_ = names.select(F.col("subject").alias("object"), F.col("node_id").alias("object_id"))
    said = row.join(subject, "subject").join(object_, "object", "left").select(
        "subject_id", "predicate", "object_id", F.when(F.col("object_id").isNull(), F.col("object")).alias("object_value"), F.lit(polarity).alias("polarity"), "statement",
        F.lit(None).cast("bigint").alias("episode_id"), "confidence", F.lit("personal").alias("sensitivity"), F.lit("user").alias("extractor"), at.alias("at"),
    )
    said = written(said, "tool-claim")
    seen = facts.observations_of(tables["fact"], said).select(*tables["observation"].columns)
    # Written, so that a call doesn't compute those before it again.
    return tables | {"fact": written(facts.assert_facts(tables["fact"], said, observation=tables["observation"]), "tool-fact"), "observation": written(tables["observation"].unionByName(seen), "tool-observation")}


def upsert_alias(tables: dict[str, DataFrame], name: str, alias: str) -> dict[str, DataFrame]:
    spark = tables["nodes"].sparkSession
    new = resolved_names(spark, tables, [name]).select("node_id", F.lit(alias).alias("alias"))
    return tables | {"alias": graph.add_aliases(tables["alias"], new)}


def upsert_episode(tables: dict[str, DataFrame], episode: DataFrame) -> dict[str, DataFrame]:
    """The tables after an episode with a source's columns, linked like any other."""
    return ingest_run(tables, episode)


def set_alias_of_owner(tables: dict[str, DataFrame], node_id: str) -> dict[str, DataFrame]:
    return tables | {"identifier": graph.set_owner(tables["identifier"], node_id)}


def review(tables: dict[str, DataFrame], k: int, proposer: str | None = None, predicate: str | None = None) -> DataFrame:
    """What waits for a reviewer: the oldest of a class, or the surest of all."""
    if proposer and predicate:
        return triage.pending_in_class(tables["candidate"], proposer, predicate, k)
    return facts.pending(tables["candidate"], k, proposer, predicate)


def decide(tables: dict[str, DataFrame], accepted: list[int], rejected: list[int], reason: str | None = None) -> dict[str, DataFrame]:
    """The tables after a reviewer's decisions; accepted candidates become facts where their subject is one node."""
    spark = tables["candidate"].sparkSession
    candidate = triage.reject(tables["candidate"], spark.createDataFrame([(i,) for i in rejected], "candidate_id bigint"), reason)
    candidate = written(candidate, "tool-candidate")
    lanes = spark.createDataFrame([(i, "accept") for i in accepted], "candidate_id bigint, lane string").join(candidate.where("status = 'proposed'").select("candidate_id"), "candidate_id", "left_semi")
    wanted = candidate.join(lanes, "candidate_id", "left_semi").select(F.explode(F.array("subject", "object_value")).alias("name")).where("name IS NOT NULL AND trim(name) <> ''").distinct()
    one = resolve.resolve_unique(resolve.resolve_all(wanted.select(F.col("name").alias("query_id"), "name"), tables["nodes"], tables["alias"], tables["identifier"]))
    said = triage.accepted_claims(candidate.withColumns({c: F.lit(None).cast("bigint") for c in ("episode_id",) if c not in candidate.columns} | {c: F.lit(None).cast("timestamp_ntz") for c in ("created_at",) if c not in candidate.columns}), lanes, one.select(F.col("query_id").alias("subject"), "node_id"))
    settled = triage.settle(candidate, lanes).select(*tables["candidate"].columns)
    return tables | {"candidate": written(settled, "tool-candidate"), "fact": written(facts.assert_facts(tables["fact"], written(said, "tool-claim")), "tool-fact")}


def entity(tables: dict[str, DataFrame], node_id: str, as_of: Column | None = None) -> DataFrame:
    """(part, text) about a node: its name, other names, and its facts, now or as of a time."""
    own = facts.facts_as_of(tables["fact"], as_of).where((F.col("subject_id") == node_id) | (F.col("object_id") == node_id)) if as_of is not None else facts.facts_for_node(tables["fact"], node_id)
    name = tables["nodes"].where(F.col("node_id") == node_id).select(F.lit("name").alias("part"), F.concat_ws(": ", "node_type", "name").alias("text"))
    also = tables["alias"].where(F.col("node_id") == node_id).select(F.lit("alias"), "alias")
    return name.union(also).union(own.select(F.lit("fact"), F.when(F.col("polarity") == "negative", F.concat(F.lit("[KNOWN FALSE] "), "statement")).otherwise(F.col("statement"))))


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, cursor, items_seen) of each source, and the tombstones that it has."""
    dead = ingest.list_tombstones(tables["tombstone"]).groupBy("source").agg(F.count("*").alias("tombstones"))
    return tables["cursor"].join(dead, "source", "left").withColumn("tombstones", F.coalesce("tombstones", F.lit(0)))


def live_statement(fact: DataFrame, statement: str) -> DataFrame:
    """Live facts that say the same, punctuation and case aside."""
    return fact.where(fn.is_live() & (fn.normalize(F.col("statement")) == fn.normalize(F.lit(statement))))
