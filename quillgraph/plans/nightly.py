"""The nightly sequence over a graph's tables: link, repair, decay, triage, digest, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregates, facts, ingest, link, triage
from ..session import written


def nightly(tables: dict[str, DataFrame], as_of: Column, half_lives: DataFrame) -> dict[str, DataFrame]:
    """Deltas and reports; what later steps read is written once.

    A step reads what the one before it wrote, as mentions found by name feed the statistics.
    """
    t = dict(tables)
    names = aggregates.unique_names(t["nodes"], t["alias"].union(link_first_names(t["nodes"])).distinct())
    found = written(link.alias_scan(t["episode"], names), "nightly-alias")
    mention = written(link.relink(t["mention"], found), "nightly-mention")
    temporal = link.link_temporal(t["episode"], mention, t["nodes"])
    mention = written(ingest.add_mentions(mention, temporal), "nightly-mention")
    connected = link.live_pairs(t["fact"])
    claims = cooccurrence_claims(t["fact"])
    by_node = t["vector"].join(mention.select("episode_id", "node_id"), "episode_id").select("episode_id", "node_id", "embedding")
    one_name = names.select(F.col("name").alias("subject"), "node_id")
    return {
        "mention": mention,
        "person_interaction": aggregates.person_interactions(t["episode"], mention, t["nodes"], as_of),
        "npmi": link.link_npmi(mention, connected),
        "structural": link.link_structural(connected, connected),
        "knn": link.link_knn(by_node, t["nodes"], connected),
        "decay": facts.npmi_decay(claims, mention),
        "phantoms": facts.phantoms(claims, mention),
        "lanes": triage.precheck(t["candidate"], t["fact"], one_name, facts.ladder(reviewed(t["candidate"]))),
        "summaries": aggregates.stale_summaries(mention, t["episode"], t["context"].select("node_id", "summary_at"), 5),
        "rules": link.run_rules(t["fact"], resolved_candidates(t["candidate"], names)),
        "duplicates": facts.duplicate_facts(t["fact"]),
        "verdicts": facts.verdicts(t["fact"], t["observation"], t["episode"], t["nodes"], mention, aggregates.stale_facts(t["fact"], t["observation"], t["episode"], half_lives, as_of)),
        "digest": facts.memory_digest(t["fact"]),
        "alerts": alerts(aggregates.health(t["episode"], t["nodes"], mention, t["fact"], t["candidate"], t["vector"])),
    }


def resolved_candidates(candidate: DataFrame, names: DataFrame) -> DataFrame:
    """(proposer, predicate, subject_id, object_id) of all candidates: a subject is a node's identifier or its one name."""
    c = candidate.select("proposer", "predicate", "subject", "object_id", F.lower(F.trim("subject")).alias("name"))
    return c.join(names, "name", "left").select("proposer", "predicate", F.coalesce("node_id", "subject").alias("subject_id"), "object_id")


def cooccurrence_claims(fact: DataFrame) -> DataFrame:
    """(fact_id, a, b, stated) of live facts that were computed from co-occurrence, with the value that they state."""
    live = fact.where(fn.is_live() & F.col("object_id").isNotNull() & F.col("extractor").isin("npmi", "linker:npmi"))
    stated = fn.parse_cooccurrence(F.col("statement"))[1]
    return live.select("fact_id", F.col("subject_id").alias("a"), F.col("object_id").alias("b"), stated.alias("stated")).where("stated IS NOT NULL")


def reviewed(candidate: DataFrame) -> DataFrame:
    """(proposer, predicate, seq, accepted): the verdicts of reviewers, commitments aside."""
    done = candidate.where("status IN ('accepted', 'rejected') AND coalesce(kind, 'fact') <> 'commitment'").where(triage.by_reviewer(candidate))
    return done.select("proposer", "predicate", F.coalesce("reviewed_at", "candidate_id").alias("seq"), (F.col("status") == "accepted").alias("accepted"))


def link_first_names(nodes: DataFrame) -> DataFrame:
    from ..operators.resolve import first_name_aliases

    return first_name_aliases(nodes)


def alerts(health: DataFrame, queue: int = 10, isolated: float = 25.0) -> DataFrame:
    """(alert, value) of the counters that are out of bounds."""
    rows = F.array(
        F.struct(F.lit("queue").alias("alert"), F.col("pending").cast("double").alias("value"), F.lit(float(queue)).alias("most")),
        F.struct(F.lit("isolated").alias("alert"), F.col("isolated_percent").alias("value"), F.lit(isolated).alias("most")),
        F.struct(F.lit("contradictions").alias("alert"), F.col("contradictions").cast("double").alias("value"), F.lit(0.0).alias("most")),
    )
    return health.select(F.explode(rows).alias("r")).select("r.*").where("value > most").select("alert", "value")


def weekly_review(task: DataFrame, projects: DataFrame, goals: DataFrame, pursued_via: DataFrame, mention: DataFrame, episode: DataFrame, as_of: Column) -> DataFrame:
    """(section, node_id): stalled projects, waiting and inbox tasks, and goals that no active project pursues."""
    stalled = facts.stalled_projects(projects, mention, episode, as_of).select(F.lit("stalled").alias("section"), "node_id")
    tasks = task.where("status IN ('waiting', 'inbox')").select(F.col("status").alias("section"), "node_id")
    active = pursued_via.join(projects.where("status = 'active'").select(F.col("node_id").alias("project_id")), "project_id", "left_semi").select(F.col("goal_id").alias("node_id")).distinct()
    idle = goals.join(active, "node_id", "left_anti").select(F.lit("goal").alias("section"), "node_id")
    return stalled.union(tasks).union(idle)
