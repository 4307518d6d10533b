"""Nodes and what hangs on them: writes, the owner, typed creation, listings, context and the log.

Writes are deltas, as in `ingest`: each function takes a table and returns the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from .facts import facts_for_node


def upsert_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """`nodes` with `incoming` (node_id, node_type, name); accesses are kept; of several rows of an identifier the least name counts."""
    new = incoming.groupBy("node_id").agg(F.min(F.struct(F.trim("name").alias("name"), F.col("node_type").alias("node_type"))).alias("n"))
    old = nodes.select("node_id", "access_count")
    made = new.join(old, "node_id", "left").select("node_id", "n.node_type", "n.name", F.coalesce("access_count", F.lit(0)).cast("int").alias("access_count"))
    return nodes.join(new.select("node_id"), "node_id", "left_anti").unionByName(made.select(*nodes.columns))


def delete_nodes(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the nodes of `ids` (node_id) and all that refers to them."""
    gone = ids.select("node_id").distinct()
    out = dict(tables)
    for name in ("nodes", "alias", "identifier", "mention"):
        if name in tables:
            out[name] = tables[name].join(gone, "node_id", "left_anti")
    if "fact" in tables:
        for column in ("subject_id", "object_id"):
            out["fact"] = out["fact"].join(gone.withColumnRenamed("node_id", column), column, "left_anti").select(*tables["fact"].columns)
    return out


def add_aliases(alias: DataFrame, incoming: DataFrame) -> DataFrame:
    """`alias` with `incoming` (node_id, alias), canonical; empty and known ones change nothing."""
    new = incoming.select("node_id", fn.canonicalize(F.col("alias")).alias("alias")).where("alias <> ''")
    return alias.select("node_id", "alias").union(new).distinct()


def upsert_identifiers(identifier: DataFrame, incoming: DataFrame) -> DataFrame:
    """`identifier` with those of `incoming` (node_id, kind, value) that no node has; of several the least node_id."""
    key = ["kind", "value"]
    new = incoming.groupBy(*key).agg(F.min("node_id").alias("node_id")).join(identifier.select(*key), key, "left_anti")
    return identifier.unionByName(new.select(*identifier.columns))


def accessed(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """`nodes` with an access more for each row of `seen` (node_id)."""
    n = seen.groupBy("node_id").agg(F.count("*").alias("_n"))
    return nodes.join(n, "node_id", "left").withColumn("access_count", (F.col("access_count") + F.coalesce("_n", F.lit(0))).cast("int")).select(*nodes.columns)


def _is_owner_mark() -> Column:
    return (F.col("kind") == "self") & (F.col("value") == "owner")


def owner(nodes: DataFrame, identifier: DataFrame) -> DataFrame:
    """The owner's node, or none."""
    return nodes.join(identifier.where(_is_owner_mark()).select("node_id"), "node_id", "left_semi")


def set_owner(identifier: DataFrame, node_id: str) -> DataFrame:
    """`identifier` with the owner's mark on one node only."""
    mark = identifier.sparkSession.createDataFrame([(node_id, "self", "owner")], "node_id string, kind string, value string")
    return identifier.where(~_is_owner_mark()).unionByName(mark.select(*identifier.columns))


def typed_nodes(wanted: DataFrame, nodes: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, node_id) and the new nodes for `wanted` (query_id, name, node_type).

    `resolved` is (query_id, node_id, ...) of :func:`resolve.resolve_all`.  A name that means one node
    that isn't an event or a document is that node; one that means several is none, as a reviewer must
    say which; any other becomes a node of its type, named by a hash of type and name.
    """
    anchors = resolved.join(nodes.select("node_id", "node_type"), "node_id").where(~F.col("node_type").isin(*fn.ANCHOR_LAST))
    one = anchors.groupBy("query_id").agg(F.min("node_id").alias("hit"), F.count("*").alias("n"))
    both = wanted.join(one, "query_id", "left")
    made = F.concat("node_type", F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0001", "node_type", fn.canonicalize(F.col("name"))), 256), 1, 12))
    linked = both.where("n IS NULL OR n = 1").where("trim(name) <> ''").select("query_id", F.coalesce("hit", made).alias("node_id"), "node_type", F.trim("name").alias("name"), F.col("hit").isNull().alias("fresh"))
    new = linked.where("fresh").groupBy("node_id", "node_type").agg(F.min("name").alias("name"))
    return linked.select("query_id", "node_id"), new.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", "node_type", "name")


def episodes_for_node(episode: DataFrame, mention: DataFrame, node_id: str, k: int) -> DataFrame:
    own = mention.where(F.col("node_id") == node_id).select("episode_id").distinct()
    return episode.join(own, "episode_id", "left_semi").orderBy(F.desc("occurred_at"), F.desc("episode_id")).limit(k)


def tagged_with(annotation: DataFrame, tags: list[str]) -> DataFrame:
    """(episode_id) of the episodes that have all of the tags."""
    want = sorted({t.strip().lstrip("#").lower() for t in tags})
    hits = annotation.where((F.col("kind") == "tag") & F.col("body").isin(*want)).groupBy("episode_id").agg(F.countDistinct("body").alias("n"))
    return hits.where(F.col("n") == len(want)).select("episode_id")


def episodes_by_tag(episode: DataFrame, annotation: DataFrame, tag: str, k: int) -> DataFrame:
    return episode.join(tagged_with(annotation, [tag]), "episode_id", "left_semi").orderBy(F.desc("occurred_at"), F.desc("episode_id")).limit(k)


def facts_by_tag(fact: DataFrame, annotation: DataFrame, tag: str, k: int) -> DataFrame:
    """Live facts whose episode has the tag, the newest first."""
    live = fact.where(fn.is_live()).join(tagged_with(annotation, [tag]), "episode_id", "left_semi")
    return live.orderBy(F.desc("ingested_at"), "fact_id").limit(k).select(*fact.columns)


def related(fact: DataFrame, nodes: DataFrame, node_id: str, k: int) -> DataFrame:
    """(node_id, name, predicate, way, confidence): what live positive facts join to a node, the surest first."""
    live = fact.where(fn.is_live() & (F.col("polarity") == "positive") & F.col("object_id").isNotNull())
    out = live.where(F.col("subject_id") == node_id).select(F.col("object_id").alias("node_id"), "predicate", F.lit("out").alias("way"), "confidence", "fact_id")
    both = out.union(live.where(F.col("object_id") == node_id).select(F.col("subject_id").alias("node_id"), "predicate", F.lit("in").alias("way"), "confidence", "fact_id"))
    return both.join(nodes.select("node_id", "name"), "node_id", "left").orderBy(F.desc("confidence"), "fact_id", "way").limit(k).select("node_id", "name", "predicate", "way", "confidence")


def set_context(context: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """`context` (node_id, instruction, summary, summary_at, summary_stale) after `incoming` (node_id, instruction, summary).

    A null leaves what was there; a summary is fresh from `at` on.
    """
    both = context.join(incoming.select("node_id", F.col("instruction").alias("i"), F.col("summary").alias("s")), "node_id", "full")
    has = F.col("s").isNotNull()
    return both.select(
        "node_id", F.coalesce("i", "instruction", F.lit("")).alias("instruction"), F.coalesce("s", "summary", F.lit("")).alias("summary"),
        F.when(has, at).otherwise(F.col("summary_at")).alias("summary_at"), F.when(has, False).otherwise(F.coalesce("summary_stale", F.lit(False))).alias("summary_stale"),
    )


def assemble_context(chain: DataFrame, context: DataFrame, fact: DataFrame, node_id: str, budget: int, most_facts: int = 50) -> DataFrame:
    """(part, place, node_id, text, truncated) of a node's context within a token budget.

    40 % is for the node's own instruction and summary, 35 % for those of the scopes above it, from the
    root down, 25 % for its facts; an instruction comes before its summary and is cut before that is
    dropped.  `chain` is (node_id, level) of :func:`link.scope_chain`, level 0 the node.  A fact that
    doesn't fit ends the facts.
    """
    inner, above = budget * 40 // 100, budget * 35 // 100
    facts_share = budget - inner - above
    c = chain.join(context.where("instruction <> '' OR summary <> ''").select("node_id", "instruction", "summary"), "node_id")
    size_i, size_s = fn.estimate_tokens(F.col("instruction")), fn.estimate_tokens(F.col("summary"))
    # What the scopes before have spent is at most the share, so that the running sum decides all.
    before = F.coalesce(F.sum(size_i + size_s).over(Window.partitionBy(F.col("level") == 0).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.when(F.col("level") == 0, F.lit(inner)).otherwise(F.greatest(F.lit(above) - before, F.lit(0)))
    c = c.withColumn("left", left.cast("int"))
    over_i, over = size_i > F.col("left"), size_i + size_s > F.col("left")
    instruction = F.when(over_i, F.substring("instruction", F.lit(1), F.col("left") * 4)).otherwise(F.col("instruction"))
    summary = F.when(over_i, F.lit("")).when(over, F.substring("summary", F.lit(1), ((F.col("left") - size_i) * 4).cast("int"))).otherwise(F.col("summary"))
    parts = F.array(F.struct(F.lit("instruction").alias("part"), instruction.alias("text")), F.struct(F.lit("summary").alias("part"), summary.alias("text")))
    scopes = c.select("node_id", "level", over.alias("truncated"), F.explode(parts).alias("p")).where("p.text <> ''").select("p.part", (-F.col("level")).cast("bigint").alias("place"), "node_id", "p.text", "truncated")
    said = F.concat(F.when(F.col("polarity") == "negative", "[KNOWN FALSE] ").otherwise(""), F.when(F.col("valid_from").isNotNull(), F.concat(F.lit("as of "), fn.ts_text(F.col("valid_from")), F.lit(": "))).otherwise(""), "statement")
    own = facts_for_node(fact, node_id).orderBy(F.desc("ingested_at"), "fact_id").limit(most_facts).withColumns({"text": said, "place": F.row_number().over(Window.orderBy(F.desc("ingested_at"), "fact_id")).cast("bigint")})  # at most `most_facts` rows
    spent = F.sum(fn.estimate_tokens(F.col("text"))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    kept = own.withColumn("spent", spent).where(F.col("spent") <= facts_share).select(F.lit("fact").alias("part"), "place", F.lit(node_id).alias("node_id"), "text", F.lit(False).alias("truncated"))
    return scopes.union(kept)


def log_events(log: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """`log` (kind, subject, payload, at) with `incoming` (kind, subject, payload) appended."""
    return log.unionByName(incoming.select("kind", "subject", "payload", at.alias("at")))
