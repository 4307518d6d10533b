"""Queries of retrieval and of the life of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregates as agg
from ..operators import facts, link, retrieval, triage
from .aggregate_queries import _CLOCK, _DECAY_SQL, AS_OF, END, START, at, half_lives, shown
from .registry import query

_BM25 = r"""WITH docs AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM documents),
 w AS (SELECT id, unnest(words) AS term, len(words) AS dl FROM docs), tot AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(words)) AS avg_dl FROM docs),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: octet_length(encode(x)) > 2)) AS term FROM benchmark),
 c AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY term),
 s AS (SELECT query_id, id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM q JOIN c USING (term) JOIN d USING (term), tot GROUP BY ALL),
 lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
"""
_VEC = """, qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
 v AS (SELECT query_id, vec_id AS id, sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM embeddings, qv),
 vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM v)
"""


def _docs(g):
    return g.documents.select(F.col("doc_id").alias("id"), "text")


def _queries(g):
    return g.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _query_vectors(g):
    return g.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _vectors(g):
    return g.embeddings.select(F.col("vec_id").alias("id"), "embedding")


@query("ret2_bm25", _BM25 + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def _(g):
    return shown(retrieval.search(retrieval.build_index(_docs(g), stemmed=False), _queries(g), 10))


@query("ret2_stemmed", None)
def _(g):
    return shown(retrieval.search(retrieval.build_index(_docs(g)), _queries(g), 10))


@query("ret3_nearest", "WITH x AS (SELECT 1)" + _VEC + "SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM vec WHERE rank <= 10")
def _(g):
    return shown(retrieval.nearest(_vectors(g), _query_vectors(g), 10))


@query("ret6_hybrid_rrf", _BM25 + _VEC + """, arms AS (SELECT query_id, id, rank, 'bm25' AS arm FROM lex WHERE rank <= 30 UNION ALL SELECT query_id, id, rank, 'vector' FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM v WHERE id IN (SELECT doc_id FROM documents)) WHERE rank <= 30),
 fused AS (SELECT query_id, id, sum(1 / (60 + rank::DOUBLE)) AS score, CASE WHEN count(DISTINCT arm) = 2 THEN 'both' ELSE max(arm) END AS via FROM arms GROUP BY ALL)
 SELECT query_id, id, round(score, 6) AS score, via, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fused) WHERE rank <= 10""")
def _(g):
    return shown(retrieval.hybrid(_docs(g), _vectors(g), _queries(g), _query_vectors(g), 10, stemmed=False))


@query("ret5_candidates", "SELECT episode_id FROM episode WHERE sensitivity IN ('public', 'personal') AND (source LIKE 'email%' OR source LIKE 'bee%') AND episode_id IN (SELECT episode_id FROM mention WHERE node_id = 'c3')", "episode", "mention")
def _(g):
    return retrieval.candidates(g.episode, g.mention, "c3", ["email", "bee"]).select("episode_id")


@query("ret1_detect_entities", r"""WITH q AS (SELECT n_nationkey AS query_id, concat('who met ', n_name, ' and ', r_name, ' last week?') AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
 names AS (SELECT lower(n_name) AS name, concat('n', n_nationkey) AS node_id FROM nation UNION SELECT lower(r_name), concat('r', r_regionkey) FROM region),
 h AS (SELECT DISTINCT query_id, name, node_id FROM q JOIN names ON contains(concat(' ', trim(regexp_replace(lower(text), '[^\p{L}\p{N}.@]+', ' ', 'g')), ' '), concat(' ', name, ' ')) WHERE length(name) >= 3),
 m AS (SELECT query_id, name, min(node_id) AS node_id, count(DISTINCT node_id) AS candidates FROM h GROUP BY ALL)
 SELECT query_id, name, node_id, candidates > 1 AS ambiguous, candidates FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.query_id = b.query_id AND length(b.name) > length(a.name) AND contains(concat(' ', b.name, ' '), concat(' ', a.name, ' ')))""")
def _(g):
    q = g.nation.join(g.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("who met "), "n_name", F.lit(" and "), "r_name", F.lit(" last week?")).alias("text"))
    names = g.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("node_id")).union(g.region.select("r_name", F.concat(F.lit("r"), "r_regionkey")))
    return retrieval.detect_entities(q, names.withColumn("node_type", F.lit("place")))


@query("ret14_pack_budget", """WITH i AS (SELECT doc_id % 20 AS query_id, doc_id AS push_order, (doc_id % 7)::DOUBLE AS score, text FROM documents),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY score DESC, push_order) AS k FROM i),
 t AS (SELECT *, (octet_length(encode(text)) // 4)::BIGINT AS tokens FROM f WHERE k = 1)
 SELECT query_id, push_order, tokens, spent::BIGINT AS spent FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, push_order ROWS UNBOUNDED PRECEDING) AS spent FROM t) WHERE spent <= 4000""")
def _(g):
    items = g.documents.select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("push_order"), (F.col("doc_id") % 7).cast("double").alias("score"), "text")
    return retrieval.pack(items, 4000).select("query_id", "push_order", "tokens", "spent")


@query("ret11_anchored_fallback", f"SELECT episode_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, 0.01::DOUBLE AS score FROM episode WHERE sensitivity IN ('public', 'personal') AND occurred_at >= TIMESTAMP '{START}' AND occurred_at < TIMESTAMP '{END}' ORDER BY episode.occurred_at DESC, episode_id DESC LIMIT 20", "episode")
def _(g):
    return shown(retrieval.anchored_fallback(g.episode, at(START), at(END), 20))


@query("ret15_flags", _CLOCK + f""", stale AS (SELECT fact_id FROM clock JOIN {_DECAY_SQL} USING (predicate) WHERE decay > 0 AND decay * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(seen_at)) / 86400e6 / 365.25) > ln(2)),
 p AS (SELECT o_orderkey % 30 AS query_id, concat('fo', o_orderkey) AS fact_id FROM orders WHERE o_orderkey < 600), k AS (SELECT query_id, fact_id, subject_id, predicate, object_id FROM p JOIN fact USING (fact_id)),
 s AS (SELECT * FROM fact WHERE valid_to IS NULL AND invalidated_at IS NULL AND sensitivity IN ('public', 'personal')),
 fl AS (SELECT query_id, 0 AS severity, 'contradiction' AS kind, k.subject_id, k.predicate, s.fact_id AS detail FROM k JOIN s ON k.subject_id = s.subject_id AND k.predicate = s.predicate WHERE polarity = 'positive' AND k.predicate IN ('works_at', 'located_in', 'assigned_to', 'pursued_via', 'has_role') AND s.object_id <> k.object_id
 UNION ALL SELECT query_id, 1, 'denial', k.subject_id, k.predicate, s.fact_id FROM k JOIN s ON k.subject_id = s.subject_id AND k.predicate = s.predicate AND s.object_id = k.object_id WHERE polarity = 'negative'
 UNION ALL SELECT query_id, 2, 'staleness', subject_id, predicate, fact_id FROM k JOIN stale USING (fact_id)),
 one AS (SELECT query_id, severity, kind, subject_id, predicate, min(detail) AS detail FROM fl GROUP BY ALL)
 SELECT query_id, severity, kind, subject_id, predicate, detail FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY severity, subject_id, predicate) AS r FROM one) WHERE r <= 2""", "fact", "observation", "episode")
def _(g):
    packs = g.orders.where("o_orderkey < 600").select((F.col("o_orderkey") % 30).alias("query_id"), F.concat(F.lit("fo"), "o_orderkey").alias("fact_id"))
    return retrieval.flag_pack(packs, g.fact, g.observation, g.episode, half_lives(g), at(AS_OF))


@query("ret16_coverage", "SELECT i.query_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < 3 THEN 'thin' ELSE 'covered' END AS status FROM (SELECT c_custkey AS query_id FROM customer) i LEFT JOIN (SELECT user_id AS query_id, count(*) AS n FROM events WHERE event_type = 'signup' AND event_id % 8 = 0 GROUP BY ALL) USING (query_id)")
def _(g):
    return retrieval.coverage_status(g.events.where("event_type = 'signup' AND event_id % 8 = 0").select(F.col("user_id").alias("query_id")), g.customer.select(F.col("c_custkey").alias("query_id")))


@query("ret16_touch", "SELECT source AS kind, source_id AS id, count(*) AS touches, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM episode JOIN mention USING (episode_id) WHERE extractor <> 'alias' GROUP BY ALL", "episode", "mention")
def _(g):
    log = g.episode.join(g.mention, "episode_id").select(F.col("source").alias("kind"), F.col("source_id").alias("id"), F.when(F.col("extractor") == "alias", "kg.probe").otherwise("kg").alias("tool"), F.col("occurred_at").alias("at"))
    return shown(retrieval.touch(log))


@query("ret20_search_nodes", "SELECT node_id FROM nodes WHERE contains(lower(name), '#00000000')  OR contains(lower(name), 'ica')", "nodes")
def _(g):
    none = g.nodes.where("false").select("node_id", F.col("name").alias("alias"))
    return retrieval.search_nodes("ica", g.nodes, none).union(retrieval.search_nodes("#00000000", g.nodes, none)).select("node_id").distinct()


@query("ret21_suggest", "SELECT node_id, name, min(CASE WHEN lower(trim(name)) = 'a' THEN 0 WHEN starts_with(lower(trim(name)), 'a') THEN 1 ELSE 2 END)::INT AS tier FROM nodes WHERE contains(lower(trim(name)), 'a') GROUP BY node_id, name, node_type, access_count ORDER BY tier, CASE node_type WHEN 'person' THEN 0 WHEN 'project' THEN 1 WHEN 'org' THEN 2 WHEN 'topic' THEN 3 ELSE 4 END, access_count DESC, name, node_id LIMIT 25", "nodes")
def _(g):
    return retrieval.suggest("a", g.nodes, g.nodes.where("false").select("node_id", F.col("name").alias("alias")), 25)


_TIER = "CASE {c} WHEN 'public' THEN 0 WHEN 'personal' THEN 1 WHEN 'private' THEN 2 ELSE 3 END"
_F = "fact_id, subject_id, predicate, object_id, polarity"
_L = "valid_to IS NULL AND invalidated_at IS NULL"
_FC = [c.strip() for c in _F.split(",")]


@query("ret18_facts_for_node", f"SELECT {_F} FROM fact WHERE (subject_id = 'c7' OR object_id = 'c7') AND {_L}", "fact")
def _(g):
    return facts.facts_for_node(g.fact, "c7").select(*_FC)


@query("ret18_facts_as_of", f"SELECT {_F} FROM fact WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1995-06-01') AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-06-01')", "fact")
def _(g):
    return facts.facts_as_of(g.fact, at("1995-06-01")).select(*_FC)


@query("ret18_timeline", f"SELECT {_F} FROM fact WHERE subject_id = 'c7' AND valid_from >= TIMESTAMP '1993-01-01' ORDER BY valid_from, fact_id LIMIT 10", "fact")
def _(g):
    return facts.timeline(g.fact, "c7", at("1993-01-01"), k=10).select(*_FC)


@query("fct3_confidence", """, b AS (SELECT fact_id, count(DISTINCT episode_id) FILTER (WHERE sup) AS episodes, count(*) FILTER (WHERE sup AND episode_id IS NULL) AS loose, count(*) FILTER (WHERE kind = 'disputed') AS disputes,
  bool_or(kind = 'verified' AND method = 'user') AS verified, arg_min(confidence, (observation_id, confidence)) AS founding FROM (SELECT *, kind IN ('asserted', 'corroborated', 'verified') AND NOT (method IN ('npmi', 'knn', 'structural', 'temporal') OR starts_with(method, 'linker:')) AS sup FROM observation) GROUP BY fact_id),
 f AS (SELECT fact_id, coalesce(episodes + loose, 0) AS s, coalesce(disputes, 0) AS d, CASE WHEN verified THEN 19.0 WHEN founding IS NOT NULL THEN greatest(0.05, least(0.95, founding)) * 10 ELSE 1.0 END::DOUBLE AS a,
  CASE WHEN verified THEN 1.0 WHEN founding IS NOT NULL THEN (1 - greatest(0.05, least(0.95, founding))) * 10 ELSE 1.0 END::DOUBLE AS b FROM fact LEFT JOIN b USING (fact_id))
 SELECT fact_id, round((a + s) / (a + b + s + d), 6) AS posterior FROM f""", "fact", "observation")
def _(g):
    return shown(facts.confidences(g.fact, g.observation, agg.class_history(g.candidate)))


@query("fct4_supersede", f"SELECT fact_id, strftime(CASE WHEN {_L} AND o_orderkey % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE valid_to END, '%Y-%m-%d %H:%M:%S') AS valid_to, strftime(CASE WHEN {_L} AND o_orderkey % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE invalidated_at END, '%Y-%m-%d %H:%M:%S') AS invalidated_at FROM fact JOIN orders ON fact_id = concat('fo', o_orderkey)", "fact")
def _(g):
    ids = g.orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("fo"), "o_orderkey").alias("fact_id"))
    return shown(facts.close(g.fact, ids, "supersede", at(AS_OF)), "fact_id", "valid_to", "invalidated_at")


@query("pre3_duplicate_facts", f"SELECT a.fact_id AS keep, b.fact_id AS drop FROM fact a JOIN fact b ON a.subject_id = b.subject_id AND a.polarity = b.polarity AND lower(a.statement) = lower(b.statement) AND (a.observations, a.ingested_at, a.fact_id) > (b.observations, b.ingested_at, b.fact_id) WHERE a.{_L.replace('AND ', 'AND a.')} AND b.{_L.replace('AND ', 'AND b.')}", "fact")
def _(g):
    return facts.duplicate_facts(g.fact)


_VERIFY = """, ep AS (SELECT episode_id, source, sensitivity, occurred_at, concat(body, ' supplier#', lpad(CAST(episode_id % 10 AS STRING), 9, '0')) AS body FROM episode WHERE episode_id % 5 <> 0),
 vf AS (SELECT fact_id, subject_id, predicate, object_id, CASE WHEN object_id IS NULL THEN 'entry click' END AS object_value, statement, valid_from, valid_to, ingested_at, invalidated_at, confidence, polarity, sensitivity, extractor, observations, episode_id
   FROM (SELECT * REPLACE (CASE WHEN fact_id LIKE '%3' THEN NULL ELSE object_id END AS object_id, CASE WHEN extractor = 'linker:npmi' THEN 'npmi' ELSE extractor END AS extractor, CASE predicate WHEN 'has_role' THEN 'uses' WHEN 'works_at' THEN 'authored' ELSE predicate END AS predicate) FROM fact))"""


def _verified(g):
    episode = g.episode.where("episode_id % 5 <> 0").withColumn("body", F.concat("body", F.lit(" supplier#"), F.lpad((F.col("episode_id") % 10).cast("string"), 9, "0")))
    f = g.fact.withColumns({
        "object_id": F.when(F.endswith("fact_id", F.lit("3")), None).otherwise(F.col("object_id")), "extractor": F.when(F.col("extractor") == "linker:npmi", "npmi").otherwise(F.col("extractor")),
        "predicate": F.when(F.col("predicate") == "has_role", "uses").when(F.col("predicate") == "works_at", "authored").otherwise(F.col("predicate")),
    })
    return f.withColumn("object_value", F.when(F.col("object_id").isNull(), "entry click")), episode


@query("ver1_verdicts", _VERIFY + _CLOCK.replace("FROM fact f", "FROM vf f").replace("LEFT JOIN episode e", "LEFT JOIN ep e") + f""", stale AS (SELECT fact_id FROM clock JOIN {_DECAY_SQL} USING (predicate) WHERE decay > 0 AND decay * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(seen_at)) / 86400e6 / 365.25) > ln(2)),
 cited AS (SELECT fact_id, episode_id FROM vf WHERE episode_id IS NOT NULL UNION SELECT fact_id, episode_id FROM observation WHERE kind IN ('asserted', 'corroborated', 'verified') AND episode_id IS NOT NULL),
 read AS (SELECT c.fact_id, ep.body, concat(' ', trim(regexp_replace(lower(ep.body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words, trim(regexp_replace(lower(CASE WHEN vf.object_id IS NULL THEN vf.object_value ELSE n.name END), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS sought
   FROM cited c JOIN vf USING (fact_id) LEFT JOIN ep ON ep.episode_id = c.episode_id LEFT JOIN nodes n ON n.node_id = vf.object_id),
 t AS (SELECT fact_id, count(*) AS n_cited, count(body) AS n_alive, count(*) FILTER (WHERE body IS NOT NULL AND sought <> '' AND contains(words, concat(' ', sought, ' '))) AS n_supporting FROM read GROUP BY fact_id),
 m AS (SELECT DISTINCT episode_id, node_id FROM mention), u AS (SELECT count(DISTINCT episode_id) AS u FROM m), cnt AS (SELECT node_id, count(*) AS n FROM m GROUP BY node_id),
 co AS (SELECT x.node_id AS a, y.node_id AS b, count(*) AS co FROM m x JOIN m y ON x.episode_id = y.episode_id AND x.node_id < y.node_id GROUP BY ALL HAVING count(*) >= 3),
 sc AS (SELECT co.a, co.b, ln(co::DOUBLE * u / (p.n::DOUBLE * q.n)) / -ln(co::DOUBLE / u) AS npmi FROM co JOIN cnt p ON p.node_id = co.a JOIN cnt q ON q.node_id = co.b, u),
 lv AS (SELECT * FROM vf WHERE {_L})
 SELECT f.fact_id, CASE WHEN NOT (f.valid_to IS NULL AND f.invalidated_at IS NULL) THEN 'missing'
  WHEN f.predicate IN ('works_at', 'located_in', 'assigned_to', 'pursued_via', 'has_role') AND f.object_id IS NOT NULL AND EXISTS (SELECT 1 FROM lv WHERE lv.subject_id = f.subject_id AND lv.predicate = f.predicate AND lv.polarity = 'positive' AND lv.object_id IS NOT NULL AND lv.fact_id <> f.fact_id) THEN 'contradicted'
  WHEN f.polarity = 'positive' AND EXISTS (SELECT 1 FROM lv WHERE lv.subject_id = f.subject_id AND lv.predicate = f.predicate AND lv.polarity = 'negative') THEN 'denied' WHEN f.fact_id IN (SELECT fact_id FROM stale) THEN 'stale'
  WHEN f.extractor = 'npmi' AND f.object_id IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM sc WHERE a = least(f.subject_id, f.object_id) AND b = greatest(f.subject_id, f.object_id) AND npmi >= -0.1) THEN 'rederived' ELSE 'refuted' END
  WHEN coalesce(n_cited, 0) = 0 THEN 'unrooted' WHEN n_alive = 0 THEN 'unverifiable' WHEN n_supporting > 0 THEN 'supported' ELSE 'residue' END AS verdict,
  coalesce(n_cited, 0) AS n_cited, coalesce(n_alive, 0) AS n_alive, coalesce(n_supporting, 0) AS n_supporting FROM vf f LEFT JOIN t USING (fact_id)""", "fact", "observation", "episode", "nodes", "mention")
def _(g):
    fact, episode = _verified(g)
    stale = agg.stale_facts(fact, g.observation, episode, half_lives(g), at(AS_OF))
    return facts.verdicts(fact, g.observation, episode, g.nodes, g.mention, stale, threshold=-0.1).select("fact_id", "verdict", "n_cited", "n_alive", "n_supporting")


_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_TRIAGE = """, cand AS (SELECT candidate_id, CASE candidate_id % 4 WHEN 0 THEN 'llm' ELSE 'extract' END AS proposer,
  CASE candidate_id % 9 WHEN 0 THEN 'discussed' WHEN 1 THEN 'has_role' WHEN 2 THEN 'works_at' WHEN 3 THEN 'mentors' WHEN 4 THEN 'located_in' WHEN 5 THEN 'uses' ELSE 'knows' END AS predicate,
  concat('c', candidate_id % 40) AS subject, CASE WHEN candidate_id % 5 <> 0 THEN concat(CASE candidate_id % 9 WHEN 4 THEN 'n' ELSE 's' END, candidate_id % 10) END AS object_id,
  CASE WHEN candidate_id % 10 = 0 THEN concat('same words ', candidate_id % 20) WHEN candidate_id % 11 = 0 THEN concat('claim 1-URGENT by ', candidate_id % 40) WHEN candidate_id % 6 = 1 THEN concat(subject, ' was there') ELSE statement END AS statement,
  confidence, status, CASE WHEN status = 'rejected' AND candidate_id % 3 = 0 THEN 'precheck: known' END AS reject_reason, kind FROM candidate)"""
_IN = {"e": "('discussed', 'discusses', 'discussing', 'discussed_with', 'mentioned', 'mentions', 'shared', 'said', 'talked_about', 'talked_to', 'spoke_about')", "p": "('has_role', 'is', 'has', 'demonstrated')",
       "n": "('colleague_of', 'friend_of', 'family_of', 'mentors')", "d": "('works_at', 'works_on', 'collaborates_with', 'member_of', 'located_in', 'authored', 'uses', 'related_to', 'contains', 'discussed_during')",
       "s": "('works_at', 'located_in', 'assigned_to', 'pursued_via', 'has_role')"}


def _triage_candidates(g):
    return g.spark.sql(_TRIAGE.removeprefix(", cand AS (")[:-1].replace("FROM candidate", "FROM {candidate}"), candidate=g.candidate)


@query("pre1_lanes", _TRIAGE + f""", live AS (SELECT *, {_NORM.format("statement")} AS said FROM fact WHERE {_L} AND polarity = 'positive'),
 c AS (SELECT *, {_NORM.format("statement")} AS said, CASE WHEN candidate_id % 40 < 30 THEN subject END AS node_id FROM cand WHERE status = 'proposed'),
 k AS (SELECT c.*, coalesce((SELECT min(fact_id) FROM live WHERE subject_id = node_id AND live.predicate = c.predicate AND live.object_id = c.object_id), (SELECT min(fact_id) FROM live WHERE subject_id = node_id AND live.said = c.said AND c.said <> '')) AS fact_id,
   EXISTS (SELECT 1 FROM live WHERE subject_id = node_id AND live.predicate = c.predicate AND c.predicate IN {_IN["s"]} AND live.object_id IS DISTINCT FROM c.object_id AND live.object_id IS NOT NULL) AS other FROM c),
 e AS (SELECT *, CASE WHEN kind = 'commitment' THEN 'commitment' WHEN said <> '' AND said IN (SELECT {_NORM.format("statement")} FROM cand WHERE status = 'rejected' AND coalesce(reject_reason, '') NOT LIKE 'precheck:%') THEN 'rejected_before'
   WHEN predicate IN {_IN["e"]} THEN 'ephemeral' WHEN predicate IN {_IN["p"]} AND regexp_matches(concat(' ', lower(statement), ' '), ' was | were |that day|yesterday|this morning|last night|last week') THEN 'eventive' WHEN fact_id IS NOT NULL THEN 'known' END AS early FROM k),
 q AS (SELECT *, early IS NULL AND ((said <> '' AND row_number() OVER (PARTITION BY early IS NULL, subject, said ORDER BY confidence DESC, candidate_id DESC) > 1)
   OR (object_id IS NOT NULL AND node_id IS NOT NULL AND row_number() OVER (PARTITION BY early IS NULL, subject, predicate, object_id ORDER BY confidence DESC, candidate_id DESC) > 1)) AS twice FROM e)
 SELECT candidate_id, CASE WHEN early IS NOT NULL THEN early WHEN twice THEN 'queued_twice' WHEN node_id IS NULL THEN 'unresolved' WHEN other THEN 'contradiction'
   WHEN predicate NOT IN {_IN["n"]} AND (predicate = 'knows' AND proposer = 'llm' OR predicate = 'mentors' OR predicate = 'knows' AND candidate_id % 10 <> 0 OR proposer = 'llm' AND predicate IN {_IN["d"]} AND candidate_id % 3 = 0) THEN 'accept' ELSE 'review' END AS lane, CASE WHEN early = 'known' THEN fact_id END AS fact_id FROM q""", "candidate", "fact")
def _(g):
    c = _triage_candidates(g)
    resolved = c.where("candidate_id % 40 < 30").select("subject", F.col("subject").alias("node_id")).distinct()
    rungs = g.spark.createDataFrame([("llm", "knows", "trusted"), ("extract", "knows", "sampled"), ("llm", "mentors", "trusted"), ("extract", "mentors", "trusted")], "proposer string, predicate string, rung string")
    return triage.precheck(c, g.fact, resolved, rungs, c.where("candidate_id % 3 = 0").select("candidate_id"))


@query("lad1_rungs", """, h AS (SELECT 'p' AS proposer, concat('k', o_custkey % 30) AS predicate, o_orderkey AS seq, (o_orderkey * 31) % 100 >= (o_custkey % 30) * 2 AS ok FROM orders),
 w AS (SELECT *, count(*) FILTER (WHERE ok) OVER x AS a, count(*) OVER x AS n FROM h WINDOW x AS (PARTITION BY predicate ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT *, (a / n::DOUBLE + 3.8416 / (2 * n) - 1.96 * sqrt(a / n::DOUBLE * (1 - a / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS low FROM w),
 d AS (SELECT predicate, max(seq) AS last FROM h WHERE seq % 499 = 0 GROUP BY predicate), c AS (SELECT l.* FROM l LEFT JOIN d USING (predicate) WHERE last IS NULL OR seq > last),
 f AS (SELECT predicate, min(seq) AS first FROM c WHERE ok AND low >= 0.65 GROUP BY predicate), t AS (SELECT DISTINCT c.predicate FROM c JOIN f USING (predicate) WHERE ok AND low >= 0.85 AND seq > first)
 SELECT DISTINCT proposer, predicate, CASE WHEN predicate IN (SELECT predicate FROM t) THEN 'trusted' WHEN predicate IN (SELECT predicate FROM f) THEN 'sampled' ELSE 'staged' END AS rung FROM h""".replace(", h AS", "WITH h AS", 1))
def _(g):
    h = g.orders.select(F.lit("p").alias("proposer"), F.concat(F.lit("k"), F.col("o_custkey") % 30).alias("predicate"), F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 31) % 100 >= (F.col("o_custkey") % 30) * 2).alias("accepted"))
    return facts.ladder(h, h.where("seq % 499 = 0").select("proposer", "predicate", "seq"))


_CLAIMS = ", claims AS (SELECT concat('k', a.p_partkey, '-', b.p_partkey) AS fact_id, least(concat('p', a.p_partkey), concat('p', b.p_partkey)) AS a, greatest(concat('p', a.p_partkey), concat('p', b.p_partkey)) AS b, 0.3::DOUBLE AS stated FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey < 300)"
_PAIR1 = ", cnt AS (SELECT node_id, count(*) AS n FROM basket GROUP BY node_id), u AS (SELECT count(DISTINCT episode_id) AS universe FROM basket), co AS (SELECT x.node_id AS a, y.node_id AS b, count(*) AS co FROM basket x JOIN basket y ON x.episode_id = y.episode_id AND x.node_id < y.node_id GROUP BY ALL)"


def _claims(g):
    a, b = g.part.where("p_partkey < 300").select(F.col("p_partkey").alias("x")), g.part.select(F.col("p_partkey").alias("y"))
    return a.join(b, F.col("y") == F.col("x") + 1).select(F.concat(F.lit("k"), "x", F.lit("-"), "y").alias("fact_id"), F.concat(F.lit("p"), "x").alias("a"), F.concat(F.lit("p"), "y").alias("b"), F.lit(0.3).alias("stated"))


def _lines(g, claims):
    """`basket`; of few claims its rows before they are made distinct, so that those of other nodes go before any shuffle."""
    return g.lineitem.select(F.col("l_orderkey").alias("episode_id"), F.concat(F.lit("p"), "l_partkey").alias("node_id")) if link.are_few(claims) else g.basket


@query("dec1_npmi_decay", _CLAIMS + _PAIR1 + """, n AS (SELECT co.a, co.b, ln(co::DOUBLE * universe / (p.n::DOUBLE * q.n)) / -ln(co::DOUBLE / universe) AS now FROM co JOIN cnt p ON p.node_id = co.a JOIN cnt q ON q.node_id = co.b, u),
 c AS (SELECT fact_id, stated, now, CASE WHEN now IS NULL OR now < 0.24 THEN 'close' WHEN now < 0.5 * stated THEN 'alarm' WHEN abs(now - stated) > 0.01 THEN 'rewrite' END AS action FROM claims LEFT JOIN n USING (a, b))
 SELECT fact_id, stated, round(now, 6) AS now, action FROM c WHERE action IS NOT NULL ORDER BY round(abs(coalesce(c.now, 0) - stated), 9) DESC, fact_id LIMIT 40""", "basket")
def _(g):
    claims = _claims(g)
    return shown(facts.npmi_decay(claims, _lines(g, claims)))


@query("dec2_phantoms", _CLAIMS + _PAIR1 + "SELECT fact_id FROM claims ANTI JOIN co USING (a, b)", "basket")
def _(g):
    claims = _claims(g)
    return facts.phantoms(claims, _lines(g, claims))


@query("prb1_probe_targets", f""", slots AS (SELECT * FROM (VALUES ('person', 'works_at'), ('person', 'reports_to'), ('person', 'has_role'), ('person', 'located_in')) AS s(node_type, slot)),
 mis AS (SELECT node_id, count(*) AS missing FROM nodes JOIN slots USING (node_type) WHERE (node_id, slot) NOT IN (SELECT subject_id, predicate FROM fact WHERE {_L}) GROUP BY node_id),
 t AS (SELECT node_id, count(*) AS touches FROM mention GROUP BY node_id), s AS (SELECT node_id, coalesce(missing, 0) AS missing, 0::BIGINT AS stale, ln(1.0 + touches) * coalesce(missing, 0) AS score FROM t LEFT JOIN mis USING (node_id))
 SELECT node_id, missing, stale, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(s.score, 9) DESC, node_id LIMIT 50""", "nodes", "fact", "mention")
def _(g):
    slots = g.spark.createDataFrame([("person", s, True) for s in ("works_at", "reports_to", "has_role", "located_in")], "node_type string, slot string, required boolean")
    touches = g.mention.groupBy("node_id").agg(F.count("*").alias("touches"))
    return shown(facts.probe_targets(g.nodes, slots, g.fact, touches, g.fact.where("false"), 50))


@query("win4_queue_duplicates", r"SELECT candidate_id, row_number() OVER (PARTITION BY lower(subject), trim(regexp_replace(lower(statement), '[^\p{L}\p{N}]+', ' ', 'g')) ORDER BY confidence DESC, candidate_id DESC)::INT AS rank FROM candidate WHERE status = 'proposed'", "candidate")
def _(g):
    return facts.queue_duplicates(g.candidate)


@query("flt15_pending", "SELECT candidate_id FROM candidate WHERE status = 'proposed' AND contains(proposer, 'src1') AND predicate = 'spoke_en' AND confidence >= 0.5 ORDER BY confidence DESC, candidate_id DESC LIMIT 30", "candidate")
def _(g):
    return facts.pending(g.candidate, 30, "src1", "spoke_en", 0.5).select("candidate_id")


_CORRECT = """, cor AS (SELECT event_id AS episode_id, CASE WHEN event_id % 3 = 0 THEN concat('fo', event_id % 700) END AS fact_uid, CASE WHEN event_id % 3 <> 0 THEN upper(concat('claim 1-URGENT by ', event_id % 90)) END AS wrong,
  CASE WHEN event_id % 2 = 0 THEN concat('rather ', event_id) END AS right_, CASE WHEN event_id % 3 = 1 THEN concat('C', event_id % 90) END AS about FROM events WHERE event_id < 400),
 hit AS (SELECT c.*, f.fact_id AS f, f.valid_to IS NULL AND f.invalidated_at IS NULL AS live FROM cor c LEFT JOIN fact f ON f.fact_id = c.fact_uid OR c.fact_uid IS NULL AND lower(f.statement) = lower(c.wrong) AND (c.about IS NULL OR f.subject_id = lower(c.about))),
 tg AS (SELECT episode_id, fact_uid, any_value(right_) AS right_, count(f) FILTER (WHERE live) AS n, count(f) FILTER (WHERE NOT live) AS shut, min(f) FILTER (WHERE live) AS one FROM hit GROUP BY ALL),
 done AS (SELECT episode_id, right_, CASE WHEN n = 1 THEN one END AS fact_id, CASE WHEN n = 1 THEN 'live' WHEN n = 0 AND shut > 0 THEN 'closed' ELSE 'unresolved' END AS target FROM tg)
"""


def _targets(g):
    e = F.col("event_id")
    c = g.events.where("event_id < 400").select(
        e.alias("episode_id"), F.when(e % 3 == 0, F.concat(F.lit("fo"), e % 700)).alias("fact_uid"), F.when(e % 3 != 0, F.upper(F.concat(F.lit("claim 1-URGENT by "), e % 90))).alias("wrong"),
        F.when(e % 2 == 0, F.concat(F.lit("rather "), e)).alias("right"), F.when(e % 3 == 1, F.concat(F.lit("C"), e % 90)).alias("about"),
    )
    names = g.customer.select(F.concat(F.lit("c"), "c_custkey").alias("about"), F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    return triage.correction_targets(c, g.fact, names)


@query("cor1_targets", _CORRECT + "SELECT episode_id, fact_id, target FROM done", "fact")
def _(g):
    return _targets(g).select("episode_id", "fact_id", "target")


@query("cor1_apply", _CORRECT + f""", gone AS (SELECT DISTINCT fact_id FROM done WHERE target = 'live'), neg AS (SELECT DISTINCT subject_id, predicate, object_id FROM done JOIN fact USING (fact_id) WHERE target = 'live' AND right_ IS NULL)
 SELECT 'fact' AS part, subject_id AS a, predicate AS b, polarity AS c, count(*) AS n FROM (SELECT subject_id, predicate, polarity FROM fact WHERE {_L} AND fact_id NOT IN (SELECT fact_id FROM gone)
   UNION ALL SELECT subject_id, predicate, 'negative' FROM neg WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.{_L.replace("AND ", "AND f.")} AND f.subject_id = neg.subject_id AND f.predicate = neg.predicate AND f.object_id = neg.object_id AND f.polarity = 'negative' AND f.fact_id NOT IN (SELECT fact_id FROM gone))) GROUP BY ALL
 UNION ALL SELECT 'demotion', extractor, predicate, NULL, 1 FROM (SELECT DISTINCT extractor, predicate FROM fact WHERE fact_id IN (SELECT fact_id FROM gone))
 UNION ALL SELECT 'candidate', NULL, NULL, NULL, count(*) FROM done WHERE target = 'unresolved' OR target = 'live' AND right_ IS NOT NULL
 UNION ALL SELECT 'observation', NULL, NULL, NULL, count(*) FROM done WHERE target = 'live'""", "fact")
def _(g):
    out = triage.apply_corrections(_targets(g), g.fact, at(AS_OF))
    null = F.lit(None).cast("string")
    live = out["fact"].where(fn.is_live()).groupBy(F.lit("fact").alias("part"), F.col("subject_id").alias("a"), F.col("predicate").alias("b"), F.col("polarity").alias("c")).agg(F.count("*").alias("n"))
    demoted = out["demotion"].select(F.lit("demotion"), "proposer", "predicate", null, F.lit(1).cast("bigint"))
    counts = [out[k].agg(F.count("*").alias("n")).select(F.lit(k), null, null, null, "n") for k in ("candidate", "observation")]
    return live.union(demoted).union(counts[0]).union(counts[1])


@query("gtd1_task_board", "SELECT node_id, status, due_at::VARCHAR AS due_at FROM task WHERE status <> 'done' ORDER BY CASE status WHEN 'next' THEN 0 WHEN 'waiting' THEN 1 WHEN 'scheduled' THEN 2 WHEN 'inbox' THEN 3 ELSE 4 END, task.due_at NULLS LAST, created LIMIT 200", "task")
def _(g):
    return shown(facts.task_board(g.task, 200), "node_id", "status", "due_at")


@query("gtd1_overdue", "SELECT node_id FROM task WHERE status <> 'done' AND due_at < DATE '1996-01-01'", "task")
def _(g):
    return facts.overdue(g.task, at("1996-01-01")).select("node_id")


@query("gtd3_stalled", f"SELECT node_id FROM nodes WHERE node_type = 'person' AND node_id NOT IN (SELECT node_id FROM mention JOIN episode USING (episode_id) WHERE occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND occurred_at <= TIMESTAMP '{AS_OF}')", "nodes", "mention", "episode")
def _(g):
    return facts.stalled_projects(g.nodes.where("node_type = 'person'"), g.mention, g.episode, at(AS_OF)).select("node_id")


@query("ret27_memory_digest", f"SELECT fact_id, statement, round(confidence * (1 + 0.1 * least(observations, 10)), 6) AS salience FROM fact WHERE {_L} AND polarity = 'positive' AND sensitivity IN ('public', 'personal') ORDER BY round(confidence * (1 + 0.1 * least(observations, 10)), 9) DESC, fact_id LIMIT 20", "fact")
def _(g):
    return shown(facts.memory_digest(g.fact))


#: Facts of which some have literals, and a batch of claims with missing literals, episodes that are seen, unknown or an agent's, and none.
_ASSERT = """, base AS (SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN NULL ELSE object_id END AS object_id, CASE WHEN k % 13 = 0 THEN concat('v', k % 3) END AS object_value) FROM (SELECT *, CAST(substr(fact_id, 3) AS BIGINT) AS k FROM fact)),
 inc AS (SELECT k, subject_id, predicate, object_id, CASE WHEN k % 4 <> 1 THEN object_value END AS object_value, statement, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN k % 1000 ELSE k + 1000000 END AS episode_id, ingested_at AS said_at FROM base WHERE k % 10 IN (1, 6)),
 rows_ AS (SELECT inc.*, coalesce(inc.object_value, min(inc.object_value) OVER (PARTITION BY subject_id, predicate, object_id)) AS literal, coalesce(e.sensitivity, 'personal') AS tier, coalesce(e.episode_id % 7 = 0, false) AS agent FROM inc LEFT JOIN episode e ON e.episode_id = inc.episode_id),
 live AS (SELECT * FROM base WHERE valid_to IS NULL AND invalidated_at IS NULL AND polarity = 'positive'),
 hits AS (SELECT r.k, l.fact_id AS hit, row_number() OVER (PARTITION BY r.k ORDER BY CASE WHEN l.object_value IS NOT DISTINCT FROM r.literal THEN 0 ELSE 1 END, l.fact_id) AS place FROM rows_ r JOIN live l ON l.subject_id = r.subject_id AND l.predicate = r.predicate
   AND l.object_id IS NOT DISTINCT FROM r.object_id AND (r.literal IS NULL OR l.object_value IS NULL OR r.literal = l.object_value)),
 c AS (SELECT r.*, h.hit, coalesce(h.hit, concat_ws('|', subject_id, predicate, coalesce(object_id, '-'), coalesce(literal, '-'))) AS target, row_number() OVER (PARTITION BY coalesce(h.hit, concat_ws('|', subject_id, predicate, coalesce(object_id, '-'), coalesce(literal, '-'))) ORDER BY said_at, statement, r.episode_id NULLS LAST) AS nth
   FROM rows_ r LEFT JOIN (SELECT * FROM hits WHERE place = 1) h ON h.k = r.k),
 seen AS (SELECT fact_id, episode_id FROM fact WHERE episode_id IS NOT NULL UNION SELECT fact_id, episode_id FROM observation WHERE episode_id IS NOT NULL),
 kinds AS (SELECT c.*, CASE WHEN c.hit IS NULL AND nth = 1 THEN 'asserted' ELSE 'corroborated' END AS kind, s.fact_id IS NULL AND NOT agent AS fresh FROM c LEFT JOIN seen s ON s.fact_id = c.target AND s.episode_id = c.episode_id),
 tot AS (SELECT target, any_value(hit) AS hit, any_value(subject_id) AS subject_id, any_value(predicate) AS predicate, any_value(object_id) AS object_id, any_value(literal) AS literal, count(DISTINCT episode_id) FILTER (WHERE fresh) + count(*) FILTER (WHERE episode_id IS NULL) AS n,
   max(CASE WHEN kind = 'asserted' AND (episode_id IS NULL OR NOT agent) THEN 1 ELSE 0 END) AS own, max(CASE tier WHEN 'public' THEN 0 WHEN 'personal' THEN 1 WHEN 'private' THEN 2 ELSE 3 END) AS rank FROM kinds GROUP BY target)
"""


def _claims_in(g):
    k = F.regexp_extract("fact_id", r"(\d+)", 1).cast("bigint")
    literal = k % 13 == 0
    base = g.fact.withColumns({"object_id": F.when(~literal, F.col("object_id")), "object_value": F.when(literal, F.concat(F.lit("v"), k % 3))})
    episode_id = F.when(k % 3 == 0, None).when(k % 3 == 1, k % 1000).otherwise(k + 1_000_000)
    said = base.where((k % 10).isin(1, 6)).select(
        "subject_id", "predicate", "object_id", F.when(k % 4 != 1, F.col("object_value")).alias("object_value"), F.lit("positive").alias("polarity"), "statement", episode_id.alias("episode_id"), "confidence", F.lit("llm").alias("extractor"), F.col("ingested_at").alias("at")
    )
    episode = g.episode.withColumn("source", F.when(F.col("episode_id") % 7 == 0, "agent:x").otherwise(F.col("source")))
    return base, said, episode


@query("fct1_assert", _ASSERT + f"""SELECT b.subject_id, b.predicate, b.object_id, b.object_value, b.polarity, (b.observations + coalesce(t.n, 0))::INT AS observations, ['public', 'personal', 'private', 'secret'][greatest(coalesce(t.rank, 0), {_TIER.format(c="b.sensitivity")}) + 1] AS sensitivity FROM base b LEFT JOIN tot t ON t.hit = b.fact_id
 UNION ALL SELECT subject_id, predicate, object_id, literal, 'positive', (1 + n - own)::INT, ['public', 'personal', 'private', 'secret'][rank + 1] FROM tot WHERE hit IS NULL""", "fact", "observation", "episode")
def _(g):
    base, said, episode = _claims_in(g)
    return facts.assert_facts(base, said, episode, g.observation).select("subject_id", "predicate", "object_id", "object_value", "polarity", "observations", "sensitivity")


@query("fct2_observations", _ASSERT + "SELECT hit AS fact_id, kind, episode_id, strftime(said_at, '%Y-%m-%d %H:%M:%S') AS observed_at FROM kinds", "fact", "observation", "episode")
def _(g):
    base, said, episode = _claims_in(g)
    out = facts.observations_of(base, said, episode).join(base.select("fact_id", F.lit(True).alias("old")), "fact_id", "left")
    return shown(out.withColumn("fact_id", F.when(F.col("old"), F.col("fact_id"))), "fact_id", "kind", "episode_id", "observed_at")


@query("fn20_wilson", "SELECT k, round((k / 30.0::DOUBLE + 3.8416 / 60 - 1.96 * sqrt(k / 30.0::DOUBLE * (1 - k / 30.0::DOUBLE) / 30 + 3.8416 / 3600)) / (1 + 3.8416 / 30), 6) AS low FROM range(1, 31) t(k)")
def _(g):
    k = F.col("id").cast("double")
    return g.spark.range(1, 31).select(F.col("id").alias("k"), F.round(fn.wilson_lower_bound(k, F.lit(30.0)), 6).alias("low"))


@query("fn22_activation", "SELECT k, round(CASE WHEN k = 0 THEN -2 ELSE greatest(-2, least(4, ln(k / 0.5::DOUBLE) - 0.5 * ln(greatest(k * 3, 0.02)))) END, 6)::DOUBLE AS activation FROM range(50) t(k)")
def _(g):
    k = F.col("id").cast("double")
    return g.spark.range(50).select(F.col("id").alias("k"), F.round(fn.activation(F.when(k > 0, k).otherwise(1e-9), k * 3), 6).alias("activation"))
