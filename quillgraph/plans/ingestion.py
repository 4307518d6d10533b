"""One run of a source: upsert, raw copies, contacts, links, names, rollup and cursor, as one set of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregates, graph, ingest, link, resolve
from ..session import written

RETENTION = ("keep", "capture", "capture_delete")


def store_raw(raw: DataFrame, incoming: DataFrame) -> DataFrame:
    """`raw` (episode_id, content) with the copies of `incoming` of episodes that have none yet."""
    new = incoming.where("content IS NOT NULL").groupBy("episode_id").agg(F.min("content").alias("content"))
    return raw.unionByName(new.join(raw.select("episode_id"), "episode_id", "left_anti").select(*raw.columns))


def captured_files(raw: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path) of files whose every episode has a raw copy; deleting them is the caller's step, after the write."""
    both = incoming.join(raw.select("episode_id", F.lit(True).alias("kept")), "episode_id", "left")
    return both.where("path IS NOT NULL").groupBy("path").agg(F.min(F.coalesce("kept", F.lit(False))).alias("all_kept")).where("all_kept").select("path")


def ingest_run(tables: dict[str, DataFrame], incoming: DataFrame, retention: str = "keep") -> dict[str, DataFrame]:
    """The tables after a run, and ``outcome`` (source, source_id, episode_id, outcome).

    `incoming` has a source's columns (`base.EPISODE`), and may have `raw`, the text as it was read,
    `projects`, an array of (root, name), and `linked`, an array of node identifiers.  A changed
    episode's contacts become persons with their address, name and first name, roots become projects,
    and with the given nodes they are mentions; then all unique names are looked for in the changed
    texts.  What was unchanged or is tombstoned changes nothing but, once, its raw copy.
    """
    if retention not in RETENTION:
        raise ValueError(f"retention is one of {RETENTION}")
    key = ["source", "source_id"]
    old = tables["episode"]
    known = old.select(*key, F.col("episode_id").alias("_id"))
    outcome = ingest.upsert_outcomes(old, incoming, tables["tombstone"]).join(known, key, "left")
    outcome = written(outcome.withColumn("episode_id", F.coalesce("_id", F.xxhash64(*key))).drop("_id"), "ingest-outcome")
    changed = outcome.where("outcome IN ('inserted', 'updated')")
    episode = ingest.apply_upsert(old, outcome.select(*old.columns, "outcome"))
    out = dict(tables) | {"episode": episode}

    person = changed.select("episode_id", F.explode("people").alias("p")).select("episode_id", F.col("p.email").alias("email"), F.col("p.name").alias("display_name"))
    contact = written(person.groupBy("email", "display_name").agg(F.collect_set("episode_id").alias("episodes")).withColumn("contact_id", F.xxhash64("email", "display_name")), "ingest-contact")
    linked, new = resolve.persons_from_contacts(contact, tables["identifier"], tables["nodes"])
    named = contact.join(linked, "contact_id")
    nodes = graph.upsert_nodes(tables["nodes"], new)
    identifier = graph.upsert_identifiers(tables["identifier"], named.where("email IS NOT NULL AND trim(email) <> ''").select("node_id", F.lit("email").alias("kind"), fn.canonicalize(F.col("email")).alias("value")))
    alias = graph.add_aliases(tables["alias"], named.where("display_name IS NOT NULL").select("node_id", F.col("display_name").alias("alias")).union(resolve.first_name_aliases(new.select("node_id", "node_type", "name"))))
    links = named.select(F.explode("episodes").alias("episode_id"), "node_id", F.lit("attendee").alias("extractor"))
    if "projects" in incoming.columns:
        rooted = changed.select("episode_id", F.explode("projects").alias("p")).select("episode_id", "p.root", "p.name")
        by_path = identifier.where("kind = 'path'").select(F.col("value").alias("root"), F.col("node_id").alias("hit"))
        rooted = rooted.join(by_path, "root", "left").withColumn("node_id", F.coalesce("hit", F.concat(F.lit("project-"), F.substring(F.sha2("root", 256), 1, 12))))
        fresh = rooted.where("hit IS NULL")
        nodes = graph.upsert_nodes(nodes, fresh.select("node_id", F.lit("project").alias("node_type"), "name"))
        identifier = graph.upsert_identifiers(identifier, fresh.select("node_id", F.lit("path").alias("kind"), F.col("root").alias("value")))
        links = links.union(rooted.select("episode_id", "node_id", F.lit("attendee")))
    if "linked" in incoming.columns:
        links = links.union(changed.select("episode_id", F.explode("linked").alias("node_id"), F.lit("manual")))
    out |= {"nodes": written(nodes, "ingest-nodes"), "alias": written(alias, "ingest-alias"), "identifier": identifier}

    found = link.alias_scan(changed.select("episode_id", "body"), aggregates.unique_names(out["nodes"], out["alias"]))
    by_name = found.select("episode_id", "node_id", F.lit("alias").alias("extractor"), F.lit(0.8).alias("confidence"))
    more = written(ingest.add_mentions(links.distinct().withColumn("confidence", F.lit(1.0)), by_name), "ingest-mention")
    out["mention"] = ingest.add_mentions(tables["mention"], more)
    if "person_interaction" in tables:
        unseen = more.join(tables["mention"].select("episode_id", "node_id"), ["episode_id", "node_id"], "left_anti")
        delta = aggregates.person_interactions(changed.select("episode_id", "source", "occurred_at"), unseen, out["nodes"], F.lit("9999-12-31").cast("timestamp_ntz"))
        out["person_interaction"] = aggregates.merge_interactions(tables["person_interaction"], delta)
    if retention != "keep" and "raw" in incoming.columns:
        out["raw"] = store_raw(tables["raw"], outcome.where("outcome <> 'tombstoned'").select("episode_id", F.col("raw").alias("content")))
    seen = outcome.where("outcome <> 'tombstoned'")
    now = seen.groupBy("source").agg(F.max("occurred_at").alias("cursor"), F.count_if(F.col("outcome") != "unchanged").alias("items_seen"))
    out["cursor"] = tables["cursor"].unionByName(now).groupBy("source").agg(F.max("cursor").alias("cursor"), F.sum("items_seen").alias("items_seen"))
    out["outcome"] = outcome.select(*key, "episode_id", "outcome")
    return out


def event_claims(run: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, mentions, claims) of the calendar events that a run inserted or updated.

    An event is a node named after its source's identifier, with the first line as its name; each of the
    people invited attended it.
    """
    changed = run["outcome"].where("outcome IN ('inserted', 'updated') AND source = 'calendar.event'").select("episode_id", F.concat(F.lit("event-"), F.substring(F.sha2("source_id", 256), 1, 16)).alias("event_id"))
    e = changed.join(run["episode"].select("episode_id", "body", "occurred_at"), "episode_id")
    name = F.coalesce(F.nullif(F.trim(F.substring_index("body", "\n", 1)), F.lit("")), F.lit("(untitled event)"))
    e = e.withColumn("title", name)
    people = run["mention"].where("extractor = 'attendee'").join(run["nodes"].where("node_type = 'person'").select("node_id", F.col("name").alias("who")), "node_id")
    claims = e.join(people.select("episode_id", "node_id", "who"), "episode_id").select(
        F.col("node_id").alias("subject_id"), F.lit("attended").alias("predicate"), F.col("event_id").alias("object_id"), F.lit(None).cast("string").alias("object_value"), F.lit("positive").alias("polarity"),
        F.concat("who", F.lit(' attended "'), "title", F.lit('" on '), fn.ts_text(F.col("occurred_at"))).alias("statement"), "episode_id", F.lit(0.9).alias("confidence"), F.lit("attendee").alias("extractor"), F.col("occurred_at").alias("at"),
    )
    nodes = e.select(F.col("event_id").alias("node_id"), F.lit("event").alias("node_type"), F.col("title").alias("name"))
    return nodes, e.select("episode_id", F.col("event_id").alias("node_id"), F.lit("attendee").alias("extractor"), F.lit(1.0).alias("confidence")), claims


def sync(tables: dict[str, DataFrame], sources: dict, spark, retention: str = "keep") -> dict[str, DataFrame]:
    """The tables after a run of each of `sources` ({identifier: Source}), from its cursor on.

    A source that can't be read adds a row to ``sync_error`` (source, error), and the others go on.
    """
    errors = []
    for name, source in sources.items():
        cursor = tables["cursor"].where(F.col("source") == name).select(F.date_format("cursor", "yyyy-MM-dd HH:mm:ss")).first()  # one row
        try:
            tables = ingest_run(tables, source.fetch(spark, cursor[0] if cursor else None), retention)
        except Exception as e:  # noqa: BLE001 - whatever a source raises is reported
            errors.append((name, str(e)))
    return tables | {"sync_error": spark.createDataFrame(errors, "source string, error string")}
