"""Idempotent ingestion: upserts, tombstones, cursors, redaction and undo, as deltas.

A table is replaced by the old one without the delta's keys and the delta; a streaming query calls
the same functions for each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn


def upsert_outcomes(old: DataFrame, incoming: DataFrame, tombstone: DataFrame) -> DataFrame:
    """`incoming` episodes with content_hash and outcome: inserted, updated, unchanged or tombstoned.

    Of several rows of one (source, source_id) the last by occurred_at and body counts.
    """
    key = ["source", "source_id"]
    w = Window.partitionBy(*key).orderBy(F.desc("occurred_at"), F.desc("body"))
    last = incoming.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("content_hash", fn.content_hash(F.col("body")))
    was = old.select(*key, F.col("content_hash").alias("_hash"))
    dead = tombstone.select(*key, F.lit(True).alias("_dead")).distinct()
    both = last.join(was, key, "left").join(dead, key, "left")
    outcome = F.when(F.col("_dead"), "tombstoned").when(F.col("_hash").isNull(), "inserted").when(F.col("_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return both.withColumn("outcome", outcome).drop("_hash", "_dead")


def apply_upsert(old: DataFrame, outcomes: DataFrame) -> DataFrame:
    delta = outcomes.where("outcome IN ('inserted', 'updated')").drop("outcome")
    key = ["source", "source_id"]
    return old.join(delta.select(*key), key, "left_anti").unionByName(delta.select(*old.columns))


def lift_tombstones(tombstone: DataFrame, ids: DataFrame) -> DataFrame:
    """`tombstone` without those of `ids` (source, source_id), which the next run reads again."""
    return tombstone.join(ids.select("source", "source_id").distinct(), ["source", "source_id"], "left_anti")


def list_tombstones(tombstone: DataFrame, source: str | None = None) -> DataFrame:
    return (tombstone if source is None else tombstone.where(F.col("source") == source)).orderBy("source", "source_id")


def store_enrichment(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Enrichments (episode_id, kind, version, content): one of an episode and kind, the last of `incoming` by version."""
    key = ["episode_id", "kind"]
    new = incoming.groupBy(*key).agg(F.max(F.struct("version", "content")).alias("e")).select(*key, "e.version", "e.content")
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def stale_derivatives(outcomes: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows of vectors or enrichments whose episode changed and which must be made anew."""
    changed = outcomes.where("outcome = 'updated'").select("source", "source_id")
    return derived.join(changed, ["source", "source_id"], "left_semi")


def advance_cursor(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source, cursor, items_seen): the newest time seen, never going back; seen items add up."""
    now = outcomes.groupBy("source").agg(F.max("occurred_at").alias("cursor"), F.count("*").alias("items_seen"))
    return state.unionByName(now).groupBy("source").agg(F.max("cursor").alias("cursor"), F.sum("items_seen").alias("items_seen"))


def add_mentions(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """The most confident counts; the extractor of the first stays."""
    rows = old.select("*", F.lit(0).alias("seq")).unionByName(incoming.select("*", F.lit(1).alias("seq")))
    order = F.struct("seq", "extractor")
    return rows.groupBy("episode_id", "node_id").agg(F.min_by("extractor", order).alias("extractor"), F.max("confidence").alias("confidence"))


def frontier(table: DataFrame, done: DataFrame, key: str, newest: str, k: int) -> DataFrame:
    """The newest k rows that aren't done yet."""
    return table.join(done.select(key).distinct(), key, "left_anti").orderBy(F.desc(newest), F.desc(key)).limit(k)


def annotate(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Annotations (episode_id, kind, body); tags are canonical, repeated ones don't count."""
    body = F.when(F.col("kind") == "tag", F.regexp_replace(fn.canonicalize(F.col("body")), "^#|\\s+", "")).otherwise(F.trim("body"))
    return old.unionByName(incoming.withColumn("body", body).select(*old.columns)).dropDuplicates(["episode_id", "kind", "body"])


def redact(tables: dict[str, DataFrame], episode_id: int) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables without the episode and what depends on it, tombstone, snapshot of what was removed)."""
    gone = {name: df.where(F.col("episode_id") == episode_id) for name, df in tables.items()}
    left = {name: df.where(F.coalesce(F.col("episode_id") != episode_id, F.lit(True))) for name, df in tables.items()}
    tombstone = gone["episode"].select("source", "source_id")
    snapshot = None
    for name, df in gone.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        snapshot = rows if snapshot is None else snapshot.union(rows)
    return left, tombstone, snapshot


def undo(tables: dict[str, DataFrame], snapshot: DataFrame) -> dict[str, DataFrame]:
    """The tables with a snapshot's rows back in place."""
    out = {}
    for name, df in tables.items():
        rows = snapshot.where(F.col("table") == name).select(F.from_json("row", df.schema).alias("r")).select("r.*")
        out[name] = df.unionByName(rows.select(*df.columns))
    return out


def set_sensitivity(episode: DataFrame, ids: DataFrame, tier: str) -> DataFrame:
    if tier not in fn.TIERS:
        raise ValueError(f"unknown tier {tier}")
    hit = episode.join(ids.select(F.col("episode_id").alias("_id")).distinct(), F.col("episode_id") == F.col("_id"), "left")
    return hit.withColumn("sensitivity", F.when(F.col("_id").isNotNull(), tier).otherwise(F.col("sensitivity"))).drop("_id")


def export(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write each table as Parquet and read it back to count it; raises where a count differs."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
        if counts[name] != df.count():
            raise RuntimeError(f"{name} was not copied whole")
    return counts
