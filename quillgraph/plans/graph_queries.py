"""Queries of node writes, listings, context and whole ingestion runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fn
from ..operators import graph, link, resolve
from . import ingestion
from .aggregate_queries import AS_OF, at, shown
from .fact_queries import _L
from .registry import query

_ANNOTATION = ", annotation AS (SELECT episode_id, 'tag' AS kind, source AS body FROM episode WHERE episode_id % 2 = 0 UNION ALL SELECT episode_id, 'tag', 'fifth' FROM episode WHERE episode_id % 5 = 0)"


def _annotation(g):
    one = g.episode.where("episode_id % 2 = 0").select("episode_id", F.lit("tag").alias("kind"), F.col("source").alias("body"))
    return one.union(g.episode.where("episode_id % 5 = 0").select("episode_id", F.lit("tag"), F.lit("fifth")))


@query("ret19_episodes_for_node", "SELECT episode_id FROM episode WHERE episode_id IN (SELECT episode_id FROM mention WHERE node_id = 'c7') ORDER BY occurred_at DESC, episode_id DESC LIMIT 20", "episode", "mention")
def _(g):
    return graph.episodes_for_node(g.episode, g.mention, "c7", 20).select("episode_id")


@query("ret19_tagged", _ANNOTATION + "SELECT episode_id FROM annotation WHERE kind = 'tag' AND body IN ('fifth', 'email') GROUP BY episode_id HAVING count(DISTINCT body) = 2", "episode")
def _(g):
    return graph.tagged_with(_annotation(g), ["#Fifth", " email"])


@query("ret18_facts_by_tag", _ANNOTATION + f"SELECT fact_id FROM fact WHERE {_L} AND episode_id IN (SELECT episode_id FROM annotation WHERE body = 'fifth') ORDER BY ingested_at DESC, fact_id LIMIT 30", "episode", "fact")
def _(g):
    return graph.facts_by_tag(g.fact, _annotation(g), "fifth", 30).select("fact_id")


@query("ret25_related", f", e AS (SELECT object_id AS node_id, predicate, 'out' AS way, confidence, fact_id FROM fact WHERE {_L} AND polarity = 'positive' AND subject_id = 'c7' UNION ALL SELECT subject_id, predicate, 'in', confidence, fact_id FROM fact WHERE {_L} AND polarity = 'positive' AND object_id = 'c7') SELECT node_id, name, predicate, way, confidence FROM e LEFT JOIN nodes USING (node_id) ORDER BY e.confidence DESC, fact_id, way LIMIT 25", "fact", "nodes")
def _(g):
    return graph.related(g.fact, g.nodes, "c7", 25)


@query("er4_upsert_nodes", ", inc AS (SELECT concat('c', c_custkey + 50) AS node_id, 'person' AS node_type, concat('New ', c_custkey) AS name FROM customer) SELECT node_id, node_type, name, access_count FROM nodes WHERE node_id NOT IN (SELECT node_id FROM inc) UNION ALL SELECT i.node_id, i.node_type, i.name, coalesce(n.access_count, 0)::INT FROM inc i LEFT JOIN nodes n ON n.node_id = i.node_id", "nodes")
def _(g):
    incoming = g.customer.select(F.concat(F.lit("c"), F.col("c_custkey") + 50).alias("node_id"), F.lit("person").alias("node_type"), F.concat(F.lit(" New "), "c_custkey", F.lit(" ")).alias("name"))
    return graph.upsert_nodes(g.nodes, incoming)


@query("er4_delete_nodes", f", gone AS (SELECT node_id FROM nodes WHERE node_id LIKE '%7') SELECT 'fact' AS part, count(*) AS n FROM fact WHERE subject_id NOT IN (SELECT node_id FROM gone) AND (object_id IS NULL OR object_id NOT IN (SELECT node_id FROM gone)) UNION ALL SELECT 'mention', count(*) FROM mention WHERE node_id NOT IN (SELECT node_id FROM gone) UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE node_id NOT LIKE '%7'", "nodes", "fact", "mention")
def _(g):
    left = graph.delete_nodes({"nodes": g.nodes, "mention": g.mention, "fact": g.fact}, g.nodes.where("node_id LIKE '%7'"))
    counts = [left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in ("fact", "mention", "nodes")]
    return counts[0].union(counts[1]).union(counts[2])


@query("er5_owner", "SELECT node_id, name FROM nodes WHERE node_id = 'c7'", "nodes")
def _(g):
    none = g.nodes.where("false").select("node_id", F.lit("").alias("kind"), F.lit("").alias("value"))
    return graph.owner(g.nodes, graph.set_owner(graph.set_owner(none, "c3"), "c7")).select("node_id", "name")


@query("er11_typed", """, w AS (SELECT n_nationkey AS query_id, n_name AS name FROM nation UNION ALL SELECT 100 + p_partkey, concat('Thing ', p_partkey % 7) FROM part WHERE p_partkey <= 20 UNION ALL SELECT 200 + p_partkey, p_name FROM part WHERE p_partkey <= 40),
 h AS (SELECT query_id, any_value(w.name) AS name, count(node_id) AS n, min(node_id) AS hit FROM w LEFT JOIN nodes ON lower(trim(nodes.name)) = lower(trim(w.name)) GROUP BY query_id)
 SELECT query_id, CASE WHEN n = 1 THEN hit ELSE concat('topic-', substr(sha256(concat('topic', chr(1), lower(trim(name)))), 1, 12)) END AS node_id FROM h WHERE n <= 1""", "nodes")
def _(g):
    names = g.nation.select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("name"))
    part = g.part.where("p_partkey <= 20").select((F.col("p_partkey") + 100).alias("query_id"), F.concat(F.lit("Thing "), F.col("p_partkey") % 7).alias("name"))
    wanted = names.union(part).union(g.part.where("p_partkey <= 40").select(F.col("p_partkey") + 200, "p_name")).withColumn("node_type", F.lit("topic"))
    none = g.nodes.where("false")
    resolved = resolve.resolve_all(wanted, g.nodes, none.select("node_id", F.col("name").alias("alias")), none.select("node_id", F.lit("").alias("kind"), F.col("name").alias("value"))).where("how < 3")
    return graph.typed_nodes(wanted, g.nodes, resolved)[0]


_CONTEXT = """, chain AS (SELECT * FROM (VALUES ('r0', 3), ('n5', 2), ('s3', 1), ('c7', 0)) AS t(node_id, level)),
 ctx AS (SELECT node_id, repeat(concat('do ', node_id, '. '), 3 + level * 4) AS instruction, repeat(concat('about ', node_id, '. '), 10) AS summary FROM chain)
"""


@query("ret22_context", _CONTEXT + f""", s AS (SELECT node_id, level, instruction, summary, octet_length(encode(instruction)) // 4 AS i, octet_length(encode(summary)) // 4 AS z FROM chain JOIN ctx USING (node_id)),
 l AS (SELECT *, CASE WHEN level = 0 THEN 80 ELSE greatest(70 - coalesce(sum(i + z) OVER (PARTITION BY level = 0 ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) END AS rest FROM s),
 p AS (SELECT 'instruction' AS part, level, node_id, CASE WHEN i > rest THEN substr(instruction, 1, rest::INT * 4) ELSE instruction END AS text, i + z > rest AS truncated FROM l UNION ALL SELECT 'summary', level, node_id, CASE WHEN i > rest THEN '' WHEN i + z > rest THEN substr(summary, 1, (rest - i)::INT * 4) ELSE summary END, i + z > rest FROM l),
 f AS (SELECT row_number() OVER (ORDER BY ingested_at DESC, fact_id) AS place, concat(CASE WHEN polarity = 'negative' THEN '[KNOWN FALSE] ' ELSE '' END, CASE WHEN valid_from IS NOT NULL THEN concat('as of ', strftime(valid_from, '%Y-%m-%d %H:%M:%S'), ': ') ELSE '' END, statement) AS text FROM fact WHERE (subject_id = 'c7' OR object_id = 'c7') AND {_L}),
 r AS (SELECT *, sum(octet_length(encode(text)) // 4) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM f WHERE place <= 50)
 SELECT part, (-level)::BIGINT AS place, node_id, text, truncated FROM p WHERE text <> '' UNION ALL SELECT 'fact', place, 'c7', text, false FROM r WHERE spent <= 50""", "fact")
def _(g):
    parents = g.spark.createDataFrame([("c7", "s3"), ("s3", "n5"), ("n5", "r0")], "node_id string, parent_id string")
    chain = link.scope_chain(parents, "c7")
    text = F.repeat(F.concat(F.lit("do "), "node_id", F.lit(". ")), (3 + F.col("level") * 4).cast("int"))
    said = chain.select("node_id", text.alias("instruction"), F.repeat(F.concat(F.lit("about "), "node_id", F.lit(". ")), F.lit(10)).alias("summary"))
    none = g.spark.createDataFrame([], schema.CONTEXT)
    return graph.assemble_context(chain, graph.set_context(none, said, at(AS_OF)), g.fact, "c7", 200)


_INGEST = """, nm AS (SELECT e.*, CAST(substr(e.source_id, 3) AS BIGINT) AS k, n_name FROM episode e JOIN nation ON n_nationkey = CAST(substr(e.source_id, 3) AS BIGINT) % 25),
 old AS (SELECT source, source_id, episode_id, concat(body, ' ', n_name) AS body, occurred_at, k FROM nm WHERE k % 3 <> 0),
 inc AS (SELECT source, source_id, episode_id, concat(body, CASE WHEN k % 3 <> 0 AND k % 10 = 0 THEN ' changed ' ELSE ' ' END, n_name) AS body, occurred_at, k FROM nm WHERE k % 3 = 0 OR k % 10 = 0 OR k % 7 = 0),
 oc AS (SELECT i.*, CASE WHEN i.k % 11 = 0 THEN 'tombstoned' WHEN o.body IS NULL THEN 'inserted' WHEN o.body = i.body THEN 'unchanged' ELSE 'updated' END AS outcome FROM inc i LEFT JOIN old o ON o.source_id = i.source_id),
 ch AS (SELECT * FROM oc WHERE outcome IN ('inserted', 'updated')),
 who AS (SELECT source_id, k, CASE WHEN k % 40 < 20 THEN concat('c', k % 40) ELSE concat('person-', substr(sha256(concat('u', k % 40, '@x.org')), 1, 16)) END AS node_id FROM ch),
 al AS (SELECT DISTINCT source_id, concat('n', n_nationkey) AS node_id FROM ch JOIN nation ON contains(concat(' ', trim(regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), concat(' ', trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')))
"""


def _ingest(g):
    k = F.regexp_extract("source_id", r"(\d+)", 1).cast("bigint")
    nation = g.nation.select(F.col("n_nationkey").alias("nk"), "n_name")
    e = g.episode.withColumn("k", k).join(nation, F.col("k") % 25 == F.col("nk"))
    old = e.where("k % 3 <> 0").withColumn("body", F.concat("body", F.lit(" "), "n_name"))
    old = old.withColumns({"content_hash": fn.content_hash(F.col("body")), "meta": F.lit(None).cast("string")}).select(*[c.split()[0] for c in schema.EPISODE.split(", ")])
    glue = F.when((F.col("k") % 3 != 0) & (F.col("k") % 10 == 0), " changed ").otherwise(" ")
    address = F.concat(F.lit("U"), F.col("k") % 40, F.lit("@x.org"))
    people = F.array(F.struct(address.alias("email"), F.lit(None).cast("string").alias("name")))
    new = e.where("k % 3 = 0 OR k % 10 = 0 OR k % 7 = 0").withColumn("body", F.concat("body", glue, "n_name"))
    new = new.withColumns({"people": people, "meta": F.lit(None).cast("string"), "raw": F.col("body")}).select("source", "source_id", "body", "occurred_at", "occurred_end", "sensitivity", "people", "meta", "raw")
    nodes = g.nodes.where("node_id LIKE 'n%' OR node_id LIKE 'c%'").select(*[c.split()[0] for c in schema.NODE.split(", ")])
    ident = g.spark.range(20).select(F.concat(F.lit("c"), "id").alias("node_id"), F.lit("email").alias("kind"), F.concat(F.lit("u"), "id", F.lit("@x.org")).alias("value"))
    tables = schema.empty_graph(g.spark) | {"episode": old, "nodes": nodes, "identifier": ident, "tombstone": g.episode.where(k % 11 == 0).select("source", "source_id")}
    return ingestion.ingest_run(tables, new, "capture")


@query("ing1_outcomes", _INGEST + "SELECT source_id, outcome FROM oc", "episode")
def _(g):
    return _ingest(g)["outcome"].select("source_id", "outcome")


@query("ing1_mentions", _INGEST + "SELECT source_id, node_id, 'attendee' AS extractor, 1.0::DOUBLE AS confidence FROM who UNION ALL SELECT source_id, node_id, 'alias', 0.8 FROM al", "episode")
def _(g):
    out = _ingest(g)
    return out["mention"].join(out["episode"].select("episode_id", "source_id"), "episode_id").select("source_id", "node_id", "extractor", "confidence")


@query("ing1_nodes", _INGEST + "SELECT DISTINCT node_id, 'person' AS node_type FROM who WHERE node_id LIKE 'person-%'", "episode")
def _(g):
    return _ingest(g)["nodes"].where("node_id LIKE 'person-%'").select("node_id", "node_type")


@query("ing1_cursor", _INGEST + "SELECT source, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS cursor, count(*) FILTER (WHERE outcome <> 'unchanged') AS items_seen FROM oc WHERE outcome <> 'tombstoned' GROUP BY source", "episode")
def _(g):
    return shown(_ingest(g)["cursor"])


@query("ing6_raw", _INGEST + "SELECT source_id, body AS content FROM oc WHERE outcome <> 'tombstoned'", "episode")
def _(g):
    out = _ingest(g)
    return out["raw"].join(out["episode"].select("episode_id", "source_id"), "episode_id").select("source_id", "content")
