"""Queries of entity resolution, ingestion, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import facts, ingest, resolve
from .aggregate_queries import shown
from .registry import query

_PRI = "CASE node_type WHEN 'person' THEN 0 WHEN 'project' THEN 1 WHEN 'org' THEN 2 WHEN 'topic' THEN 3 WHEN 'place' THEN 4 ELSE 12 END"


def _alias(g):
    return g.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.lower(F.substring_index("p_name", " ", 1)).alias("alias"))


_ALIAS = ", alias AS (SELECT concat('p', p_partkey) AS node_id, lower(split_part(p_name, ' ', 1)) AS alias FROM part WHERE p_partkey % 2 = 0)"


def _identifier(g):
    return g.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("email").alias("kind"), F.concat(F.lit("S"), "s_suppkey", F.lit("@example.com")).alias("value"))


@query("er1_resolve", _ALIAS + f""", ident AS (SELECT concat('s', s_suppkey) AS node_id, concat('s', s_suppkey, '@example.com') AS value FROM supplier),
 w AS (SELECT concat('a', n_nationkey) AS query_id, lower(n_name) AS want FROM nation UNION ALL SELECT concat('b', s_suppkey), concat('s', s_suppkey, '@example.com') FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT concat('c', p_partkey), lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey < 9 UNION ALL SELECT 'z', 'customer#00000001'),
 f AS (SELECT query_id, node_id, min(how) AS how FROM (SELECT query_id, node_id, 0 AS how FROM w JOIN nodes ON want = lower(trim(name)) UNION ALL SELECT query_id, node_id, 1 FROM w JOIN alias ON want = alias UNION ALL SELECT query_id, node_id, 2 FROM w JOIN ident ON want = value) GROUP BY ALL),
 l AS (SELECT query_id, node_id, 3 AS how FROM w JOIN nodes ON contains(lower(trim(name)), want) WHERE query_id NOT IN (SELECT query_id FROM f) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_PRI}, access_count DESC, node_id) <= 5)
 SELECT query_id, node_id, how::INT AS how, row_number() OVER (PARTITION BY query_id ORDER BY {_PRI}, access_count DESC, node_id)::INT AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM l) JOIN nodes USING (node_id)""", "nodes")
def _(g):
    named = g.nation.select(F.concat(F.lit("a"), "n_nationkey").alias("query_id"), F.col("n_name").alias("name"))
    mail = g.supplier.where("s_suppkey % 9 = 0").select(F.concat(F.lit("b"), "s_suppkey"), F.concat(F.lit("s"), "s_suppkey", F.lit("@example.com")))
    part = g.part.where("p_partkey < 9").select(F.concat(F.lit("c"), "p_partkey"), F.substring_index("p_name", " ", 1))
    loose = g.spark.createDataFrame([("z", "Customer#00000001")], "query_id string, name string")
    return resolve.resolve_all(named.union(mail).union(part).union(loose), g.nodes, _alias(g), _identifier(g))


@query("er2_resolve_unique", "SELECT lower(name) AS query_id, min(node_id) AS node_id FROM nodes WHERE lower(name) IN (SELECT lower(n_name) FROM nation UNION SELECT lower(p_name) FROM part) GROUP BY lower(name) HAVING count(DISTINCT node_id) = 1", "nodes")
def _(g):
    names = g.nation.select(F.lower("n_name").alias("name")).union(g.part.select(F.lower("p_name"))).distinct()
    return resolve.resolve_unique(resolve.resolve_all(names.select(F.col("name").alias("query_id"), "name"), g.nodes, _alias(g).where("false"), _identifier(g).where("false")))


@query("er6_merge_facts", """, m AS (SELECT concat('c', c_custkey) AS dup, concat('c', c_custkey - 1) AS keep FROM customer WHERE c_custkey % 10 = 5),
 f AS (SELECT coalesce(a.keep, subject_id) AS subject_id, predicate, coalesce(b.keep, object_id) AS object_id, polarity, observations FROM fact LEFT JOIN m a ON subject_id = a.dup LEFT JOIN m b ON object_id = b.dup WHERE valid_to IS NULL AND invalidated_at IS NULL)
 SELECT subject_id, predicate, object_id, polarity, sum(observations)::INT AS observations FROM f WHERE subject_id <> object_id GROUP BY ALL""", "fact")
def _(g):
    mapping = g.customer.where("c_custkey % 10 = 5").select(F.concat(F.lit("c"), "c_custkey").alias("dup"), F.concat(F.lit("c"), F.col("c_custkey") - 1).alias("keep"))
    merged = resolve.merge_nodes(mapping, g.nodes, _alias(g), _identifier(g), g.mention, g.fact)["fact"]
    return merged.where(fn.is_live()).select("subject_id", "predicate", "object_id", "polarity", "observations")


@query("er6_merge_mentions", ", m AS (SELECT concat('c', c_custkey) AS dup, concat('c', c_custkey - 1) AS keep FROM customer WHERE c_custkey % 10 = 5) SELECT episode_id, coalesce(keep, node_id) AS node_id, min(extractor) AS extractor, max(confidence) AS confidence FROM mention LEFT JOIN m ON node_id = dup GROUP BY ALL", "mention")
def _(g):
    mapping = g.customer.where("c_custkey % 10 = 5").select(F.concat(F.lit("c"), "c_custkey").alias("dup"), F.concat(F.lit("c"), F.col("c_custkey") - 1).alias("keep"))
    return resolve.merge_nodes(mapping, g.nodes, _alias(g), _identifier(g), g.mention, g.fact)["mention"]


@query("er7_duplicate_persons", "WITH p AS (SELECT concat('x', p_partkey) AS node_id, lower(p_name) AS key FROM part), c AS (SELECT node_id, min(node_id) OVER (PARTITION BY key) AS class, count(*) OVER (PARTITION BY key) - 1 AS links FROM p WHERE contains(key, ' ')) SELECT node_id, class, links FROM c WHERE links > 0")
def _(g):
    return resolve.duplicate_persons(g.part.select(F.concat(F.lit("x"), "p_partkey").alias("node_id"), F.lit("person").alias("node_type"), F.col("p_name").alias("name")))


@query("er12_normalize_predicates", """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Works At' WHEN 1 THEN 'employed_by' WHEN 2 THEN 'mentoring' WHEN 3 THEN 'knows' ELSE 'sings' END AS predicate FROM documents)
 SELECT doc_id, CASE predicate WHEN 'Works At' THEN 'works_at' WHEN 'employed_by' THEN 'works_at' WHEN 'mentoring' THEN 'mentors' ELSE predicate END AS canonical FROM r""")
def _(g):
    p = F.col("doc_id") % 5
    rows = g.documents.select("doc_id", F.when(p == 0, "Works At").when(p == 1, "employed_by").when(p == 2, "mentoring").when(p == 3, "knows").otherwise("sings").alias("predicate"))
    vocabulary = g.spark.createDataFrame([("works_at",), ("mentors",), ("knows",)], "predicate string")
    alias = g.spark.createDataFrame([("employed_by", "works_at")], "alias string, predicate string")
    return facts.normalize_predicates(rows, vocabulary, alias).select("doc_id", "canonical")


@query("ing2_upsert", """, inc AS (SELECT source, source_id, CASE WHEN episode_id % 4 = 0 THEN concat(body, '!') ELSE body END AS body, occurred_at FROM episode WHERE episode_id % 2 = 0),
 old AS (SELECT source, source_id, sha256(body) AS h FROM episode WHERE episode_id % 3 = 0), dead AS (SELECT source, source_id FROM episode WHERE episode_id % 50 = 0)
 SELECT i.source, i.source_id, CASE WHEN d.source IS NOT NULL THEN 'tombstoned' WHEN o.h IS NULL THEN 'inserted' WHEN o.h = sha256(i.body) THEN 'unchanged' ELSE 'updated' END AS outcome
 FROM inc i LEFT JOIN old o ON i.source = o.source AND i.source_id = o.source_id LEFT JOIN dead d ON i.source = d.source AND i.source_id = d.source_id""", "episode")
def _(g):
    body = F.when(F.col("episode_id") % 4 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    incoming = g.episode.where("episode_id % 2 = 0").withColumn("body", body)
    old = g.episode.where("episode_id % 3 = 0").withColumn("content_hash", fn.content_hash(F.col("body")))
    return ingest.upsert_outcomes(old, incoming, g.episode.where("episode_id % 50 = 0")).select("source", "source_id", "outcome")


@query("ing2_apply_upsert", """, inc AS (SELECT source, source_id, concat(body, '!') AS body FROM episode WHERE episode_id % 4 = 0), old AS (SELECT source, source_id, body FROM episode WHERE episode_id % 6 = 0)
 SELECT source, source_id, body FROM inc UNION ALL SELECT source, source_id, body FROM old ANTI JOIN inc USING (source, source_id)""", "episode")
def _(g):
    incoming = g.episode.where("episode_id % 4 = 0").withColumn("body", F.concat("body", F.lit("!")))
    old = g.episode.where("episode_id % 6 = 0").withColumn("content_hash", fn.content_hash(F.col("body")))
    return ingest.apply_upsert(old, ingest.upsert_outcomes(old, incoming, g.episode.where("false"))).select("source", "source_id", "body")


@query("ing4_add_mentions", "SELECT episode_id, node_id, arg_min(extractor, (k, extractor)) AS extractor, max(confidence) AS confidence FROM (SELECT *, 0 AS k FROM mention WHERE episode_id % 2 = 0 UNION ALL SELECT episode_id, node_id, 'new', 0.9, 1 FROM mention) GROUP BY ALL", "mention")
def _(g):
    return ingest.add_mentions(g.mention.where("episode_id % 2 = 0"), g.mention.withColumns({"extractor": F.lit("new"), "confidence": F.lit(0.9)}))


@query("ing5_cursor", "SELECT source, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS cursor, count(*) AS items_seen FROM episode GROUP BY source", "episode")
def _(g):
    outcomes = [g.episode.where(F.col("episode_id") % 2 == k) for k in (0, 1)]
    state = ingest.advance_cursor(g.episode.where("false").select("source", F.col("occurred_at").alias("cursor"), F.lit(0).cast("bigint").alias("items_seen")), outcomes[0])
    return shown(ingest.advance_cursor(state, outcomes[1]))


@query("src38_frontier", "SELECT episode_id FROM episode WHERE episode_id NOT IN (SELECT episode_id FROM vector) ORDER BY occurred_at DESC, episode_id DESC LIMIT 100", "episode", "vector")
def _(g):
    return ingest.frontier(g.episode, g.vector, "episode_id", "occurred_at", 100).select("episode_id")


@query("ing13_annotate", "SELECT DISTINCT doc_id AS episode_id, 'tag' AS kind, lower(lang) AS body FROM documents")
def _(g):
    tags = g.documents.select(F.col("doc_id").alias("episode_id"), F.lit("tag").alias("kind"), F.col("lang").alias("body"))
    return ingest.annotate(tags, tags.withColumn("body", F.concat(F.lit(" #"), F.upper("body"))))


@query("fn2_normalize", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS normal FROM documents")
def _(g):
    return g.documents.select("doc_id", fn.normalize(F.col("text")).alias("normal"))


@query("fn7_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(g):
    a, b = g.embeddings.alias("a"), g.embeddings.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(fn.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query("flt9_json_path", "SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY ALL")
def _(g):
    return g.events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("flt10_frontier_semi_anti", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(g):
    return g.documents.join(g.labels.where("quality = 1"), "doc_id", "left_semi").join(g.labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("fn23_health_score", "SELECT event_id, round(0.8 * exp(-0.015 * (event_id % 90)) * least(1.0, 0.3 + 0.1 * (event_id % 11)), 6)::DOUBLE AS health FROM events")
def _(g):
    e = F.col("event_id")
    return g.events.select("event_id", F.round(fn.health_score(F.lit(0.8), e % 90, e % 11), 6).alias("health"))


@query("fn24_sensitivity_rank", "SELECT episode_id, CASE sensitivity WHEN 'public' THEN 0 WHEN 'personal' THEN 1 WHEN 'private' THEN 2 ELSE 3 END AS rank FROM episode", "episode")
def _(g):
    return g.episode.select("episode_id", fn.sensitivity_rank(F.col("sensitivity")).alias("rank"))


@query("fn11_lexically_supports", r"SELECT doc_id, contains(concat(' ', trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), ' mit license ') AS supported FROM documents")
def _(g):
    return g.documents.select("doc_id", fn.lexically_supports(F.col("text"), F.lit("MIT License")).alias("supported"))


@query("fn10_contains_word", "SELECT doc_id, regexp_matches(text, '(^|[^0-9A-Za-z])License([^0-9A-Za-z]|$)') AS found FROM documents")
def _(g):
    return g.documents.select("doc_id", fn.contains_word(F.col("text"), F.lit("License")).alias("found"))


@query("stream_daily_counts", "SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d %H:%M:%S') AS day, source, count(*) AS n FROM episode GROUP BY ALL", "episode")
def _(g):
    by = g.episode.groupBy(F.window(F.col("occurred_at"), "1 day"), "source").agg(F.count("*").alias("n"))
    return shown(by.select(F.col("window.start").alias("day"), "source", "n"))
