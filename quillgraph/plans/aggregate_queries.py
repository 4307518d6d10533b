"""Queries of the aggregations, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregates as agg
from ..operators import link
from .registry import query

AS_OF = "2024-01-25 00:00:00"
START, END = "2024-01-05 00:00:00", "2024-01-15 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def shown(df, *columns: str):
    """Times as text, doubles at six digits."""
    out = []
    for name, kind in df.select(*columns).dtypes if columns else df.dtypes:
        c = F.col(name)
        out.append((fn.ts_text(c) if kind.startswith("timestamp") else F.round(c, 6) if kind == "double" else c.cast("string") if kind == "date" else c).alias(name))
    return df.select(*out)


T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_CHANNEL = "CASE source WHEN 'calendar.event' THEN 'meeting' WHEN 'bee.conversation' THEN 'spoken' WHEN 'email' THEN 'email' WHEN 'sms' THEN 'message' WHEN 'slack' THEN 'slack' ELSE 'other' END"
_ROLLUP = f""", rollup AS (SELECT node_id, min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) AS interactions,
 arg_max({_CHANNEL}, (occurred_at, episode_id)) AS last_channel, arg_max(episode_id, (occurred_at, episode_id)) AS last_episode_id,
 max(occurred_at) FILTER (WHERE source = 'calendar.event') AS last_meeting_at, max(occurred_at) FILTER (WHERE source = 'bee.conversation') AS last_spoken_at,
 max(occurred_at) FILTER (WHERE source = 'email') AS last_email_at, max(occurred_at) FILTER (WHERE source = 'sms') AS last_message_at,
 max(occurred_at) FILTER (WHERE source = 'slack') AS last_slack_at
 FROM mention JOIN episode USING (episode_id) WHERE node_id IN (SELECT node_id FROM nodes WHERE node_type = 'person') AND occurred_at <= TIMESTAMP '{AS_OF}' GROUP BY node_id)
"""
_TIMES = [f"last_{c}_at" for c in agg.CHANNELS.values()]


def rollup(g):
    return agg.person_interactions(g.episode, g.mention, g.nodes, at(AS_OF))


@query("agg3_person_interactions", _ROLLUP + f"SELECT node_id, interactions, last_channel, last_episode_id, {', '.join(T.format(c) for c in ['first_at', 'last_at', *_TIMES])} FROM rollup", "episode", "mention", "nodes")
def _(g):
    return shown(rollup(g))


@query("agg4_touch_person", _ROLLUP.replace(f"AND occurred_at <= TIMESTAMP '{AS_OF}'", "") + f"SELECT node_id, interactions, last_channel, last_episode_id, {', '.join(T.format(c) for c in ['first_at', 'last_at', *_TIMES])} FROM rollup", "episode", "mention", "nodes")
def _(g):
    late = at("2999-01-01 00:00:00")
    parts = [agg.person_interactions(g.episode.where(F.col("episode_id") % 2 == k), g.mention, g.nodes, late) for k in (0, 1)]
    return shown(agg.merge_interactions(*parts))


@query("agg5_get_person_interaction", _ROLLUP + "SELECT node_id, interactions, last_channel FROM rollup WHERE node_id = 'c7'", "episode", "mention", "nodes")
def _(g):
    return agg.person_interactions(g.episode, g.mention.where("node_id = 'c7'"), g.nodes, at(AS_OF)).select("node_id", "interactions", "last_channel")


@query("agg10_people_ranking", _ROLLUP + f"SELECT node_id, name, interactions, last_channel, {T.format('last_at')} FROM rollup JOIN nodes USING (node_id) ORDER BY interactions DESC, node_id LIMIT 10", "episode", "mention", "nodes")
def _(g):
    return shown(agg.people_ranking(rollup(g), g.nodes, 10))


_WINDOW = f"occurred_at >= TIMESTAMP '{START}' AND occurred_at < TIMESTAMP '{END}'"


@query("agg10_people_ranking_in_range", f"SELECT node_id, name, count(DISTINCT episode_id) AS interactions FROM mention JOIN nodes USING (node_id) JOIN episode USING (episode_id) WHERE node_type = 'person' AND {_WINDOW} GROUP BY ALL ORDER BY interactions DESC, node_id LIMIT 15", "episode", "mention", "nodes")
def _(g):
    return agg.people_ranking_in_range(g.episode, g.mention, g.nodes, at(START), at(END), 15)


@query("agg1_universe", "SELECT count(DISTINCT episode_id) AS n FROM mention", "mention")
def _(g):
    return g.mention.agg(F.countDistinct("episode_id").alias("n"))


@query("agg2_pairs_having", "SELECT a.node_id AS a, b.node_id AS b, count(*) AS co FROM basket a JOIN basket b ON a.episode_id = b.episode_id AND a.node_id < b.node_id GROUP BY ALL HAVING count(*) >= 3", "basket")
def _(g):
    return link.shared_counts(g.basket, 3)


@query("agg6_source_coverage", f"SELECT source, count(*) AS n, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM episode WHERE episode_id IN (SELECT episode_id FROM mention WHERE node_id = 'c3') GROUP BY source", "episode", "mention")
def _(g):
    return shown(agg.source_coverage(g.episode, g.mention, "c3"))


@query("agg7_list_tags", "SELECT lang AS tag, count(*) AS n FROM documents GROUP BY lang")
def _(g):
    return agg.list_tags(g.documents.select(F.lit("tag").alias("kind"), F.col("lang").alias("body")))


@query("agg8_known_sources", "SELECT DISTINCT source FROM episode", "episode")
def _(g):
    return agg.known_sources(g.episode)


@query("agg9_entity_source_counts", f"SELECT node_id, source, count(*) AS n FROM (SELECT DISTINCT episode_id, node_id FROM mention) JOIN episode USING (episode_id) WHERE {_WINDOW} GROUP BY ALL", "episode", "mention")
def _(g):
    return agg.entity_source_counts(g.episode, g.mention, at(START), at(END))


@query("agg11_source_counts", f"SELECT source, count(*) AS n FROM episode WHERE {_WINDOW} GROUP BY source", "episode")
def _(g):
    return agg.source_counts(g.episode, at(START), at(END))


_WILSON = "(a / n + 3.8416 / (2 * n) - 1.96 * sqrt(a / n * (1 - a / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query("agg12_class_history", f"SELECT proposer, predicate, accepted, judged, round({_WILSON}, 6) AS lower_bound FROM (SELECT proposer, predicate, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) AS judged, accepted::DOUBLE AS a, judged::DOUBLE AS n FROM candidate WHERE status <> 'proposed' GROUP BY ALL)", "candidate")
def _(g):
    return shown(agg.class_history(g.candidate))


@query("win9_accept_streak", ", m AS (SELECT *, max(reviewed_at) FILTER (WHERE status = 'rejected') OVER (PARTITION BY proposer, predicate) AS lr FROM candidate WHERE status <> 'proposed') SELECT proposer, predicate, count(*) FILTER (WHERE status = 'accepted' AND (lr IS NULL OR reviewed_at > lr)) AS streak FROM m GROUP BY ALL", "candidate")
def _(g):
    return agg.accept_streak(g.candidate)


@query("agg13_verdict_scorecard", "SELECT CASE quality WHEN 1 THEN 'accept' ELSE 'reject' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN toxic = 1 THEN 'wrong' ELSE 'right' END AS outcome, count(*) AS n FROM labels GROUP BY ALL")
def _(g):
    outcome = F.when(F.col("doc_id") % 3 != 0, F.when(F.col("toxic") == 1, "wrong").otherwise("right"))
    return agg.verdict_scorecard(g.labels.select(F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"), outcome.alias("outcome")))


@query("agg14_live_contradictions", "SELECT subject_id, predicate, count(DISTINCT object_id) AS n_objects FROM fact WHERE valid_to IS NULL AND invalidated_at IS NULL AND polarity = 'positive' AND predicate IN ('works_at', 'located_in', 'assigned_to', 'pursued_via', 'has_role') GROUP BY ALL HAVING count(DISTINCT object_id) > 1", "fact")
def _(g):
    return agg.live_contradictions(g.fact)


@query("agg15_unique_names", ", n AS (SELECT node_id, CASE WHEN starts_with(node_id, 's') THEN 'document' ELSE node_type END AS node_type, name FROM nodes), both_ AS (SELECT node_id, lower(trim(name)) AS name FROM n WHERE node_type NOT IN ('event', 'series', 'document', 'artifact') UNION SELECT node_id, lower(split_part(name, ' ', 1)) FROM n WHERE node_type = 'topic') SELECT name, min(node_id) AS node_id FROM both_ WHERE length(name) >= 3 GROUP BY name HAVING count(DISTINCT node_id) = 1", "nodes")
def _(g):
    alias = g.nodes.where("node_type = 'topic'").select("node_id", F.lower(F.substring_index("name", " ", 1)).alias("alias"))
    nodes = g.nodes.withColumn("node_type", F.when(F.startswith("node_id", F.lit("s")), "document").otherwise(F.col("node_type")))
    return agg.unique_names(nodes, alias)


#: Rate of change a year; the others aren't verified again.
DECAY = {
    "attended": 0.0, "authored": 0.0, "originated_in": 0.0, "works_at": 0.23, "located_in": 0.23, "member_of": 0.35, "collaborates_with": 0.35, "uses": 0.69, "works_on": 1.39,
    "pursued_via": 1.39, "assigned_to": 8.3, "waiting_on": 8.3, "blocked_by": 8.3,
}
_DECAY_SQL = "(VALUES " + ", ".join(f"('{p}', {d}::DOUBLE)" for p, d in DECAY.items()) + ") AS decay(predicate, decay)"
_CLOCK = """, clock AS (SELECT f.*, coalesce(max(coalesce(e.occurred_at, o.observed_at)), any_value(f.valid_from), any_value(f.ingested_at)) AS seen_at
 FROM fact f LEFT JOIN (SELECT * FROM observation WHERE kind IN ('asserted', 'corroborated', 'verified')) o ON f.fact_id = o.fact_id
 LEFT JOIN episode e ON o.episode_id = e.episode_id WHERE f.valid_to IS NULL AND f.invalidated_at IS NULL GROUP BY ALL)
"""


def half_lives(g):
    return g.spark.createDataFrame(list(DECAY.items()), "predicate string, decay double")


@query("agg16_stale_facts", _CLOCK + f"SELECT fact_id, predicate, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at, round((epoch_us(TIMESTAMP '2024-01-25 00:00:00') - epoch_us(seen_at)) / 86400e6 / 365.25, 6) AS age_years FROM clock JOIN {_DECAY_SQL} USING (predicate) WHERE decay > 0 AND decay * ((epoch_us(TIMESTAMP '2024-01-25 00:00:00') - epoch_us(seen_at)) / 86400e6 / 365.25) > ln(2)", "fact", "observation", "episode")
def _(g):
    return shown(agg.stale_facts(g.fact, g.observation, g.episode, half_lives(g), at(AS_OF)), "fact_id", "predicate", "seen_at", "age_years")


_RANK = "CASE sensitivity WHEN 'public' THEN 0 WHEN 'personal' THEN 1 WHEN 'private' THEN 2 ELSE 3 END"


@query("agg17_strictest_sensitivity", f"SELECT node_id, ['public', 'personal', 'private', 'secret'][max({_RANK}) + 1] AS sensitivity FROM mention JOIN episode USING (episode_id) GROUP BY node_id", "mention", "episode")
def _(g):
    return agg.strictest_sensitivity(g.mention.join(g.episode, "episode_id"), "node_id")


@query("agg18_centroids", "SELECT node_id, n, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS squared, round(c[1], 6) AS first_value FROM (SELECT node_id, max(n) AS n, list(x ORDER BY pos) AS c FROM (SELECT node_id, pos, avg(x) AS x, count(*) AS n FROM (SELECT node_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM vector) GROUP BY ALL) GROUP BY node_id)", "vector")
def _(g):
    c = agg.centroids(g.vector)
    return c.select("node_id", "n", F.round(fn.dot(F.col("centroid"), F.col("centroid")), 6).alias("squared"), F.round(F.element_at("centroid", 1), 6).alias("first_value"))


@query("agg19_review_clusters", """, r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY proposer, predicate, kind ORDER BY confidence DESC, candidate_id) - 1 AS rn FROM candidate WHERE status = 'proposed' WINDOW w AS (PARTITION BY proposer, predicate, kind)),
 s AS (SELECT *, greatest(1, n // 3) AS stride FROM r)
 SELECT proposer, predicate, kind, count(*) AS pending, round(min(confidence), 6) AS least_confidence, round(max(confidence), 6) AS most_confidence,
 coalesce(string_agg(candidate_id::VARCHAR, ',' ORDER BY rn) FILTER (WHERE rn % stride = 0 AND rn / stride < 3), '') AS sample_ids FROM s GROUP BY ALL""", "candidate")
def _(g):
    return shown(agg.review_clusters(g.candidate, 3))


@query("agg20_recurring_subjects", "SELECT lower(trim(subject)) AS subject, count(*) AS n FROM candidate WHERE status = 'proposed' AND kind = 'fact' AND lower(trim(subject)) NOT IN (SELECT concat('person ', n_nationkey) FROM nation) GROUP BY ALL HAVING count(*) >= 3", "candidate")
def _(g):
    return agg.recurring_subjects(g.candidate, g.nation.select(F.concat(F.lit("person "), "n_nationkey").alias("name")))


_LIVE = "valid_to IS NULL AND invalidated_at IS NULL"


@query("agg21_health", f""", connected AS (SELECT subject_id AS node_id FROM fact WHERE {_LIVE} UNION SELECT object_id FROM fact WHERE {_LIVE} UNION SELECT node_id FROM mention)
 SELECT *, round(100.0 * isolated / nodes, 4)::DOUBLE AS isolated_percent FROM (SELECT (SELECT count(*) FROM episode) AS episodes, (SELECT count(DISTINCT source) FROM episode) AS sources, (SELECT count(*) FROM episode WHERE sensitivity NOT IN ('public', 'personal')) AS hidden_episodes,
 (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM connected)) AS isolated, (SELECT count(*) FROM mention) AS mentions,
 (SELECT count(DISTINCT episode_id) FROM mention) AS mentioned_episodes, (SELECT count(*) FROM fact) AS facts, (SELECT count(*) FROM fact WHERE {_LIVE}) AS live_facts,
 (SELECT count(*) FROM fact WHERE invalidated_at IS NOT NULL) AS invalidated_facts, (SELECT count(*) FROM candidate WHERE status = 'proposed') AS pending, (SELECT count(*) FROM vector) AS vectors,
 (SELECT count(*) FROM (SELECT 1 FROM fact WHERE {_LIVE} AND polarity = 'positive' AND predicate IN ('works_at', 'located_in', 'assigned_to', 'pursued_via', 'has_role') GROUP BY subject_id, predicate HAVING count(DISTINCT object_id) > 1)) AS contradictions)""", "episode", "nodes", "mention", "fact", "candidate", "vector")
def _(g):
    return agg.health(g.episode, g.nodes, g.mention, g.fact, g.candidate, g.vector)


@query("agg22_evaluation", "SELECT source AS job, count(*) AS queries, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM (SELECT source, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 23 + 1 END AS r FROM documents) GROUP BY source")
def _(g):
    rank = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 23 + 1)
    return shown(agg.evaluation(g.documents.select(F.col("source").alias("job"), rank.alias("rank"))))


@query("agg23_observation_counts", "SELECT fact_id, kind, count(*) AS n FROM observation GROUP BY ALL", "observation")
def _(g):
    return agg.observation_counts(g.observation)


@query("agg24_stale_summaries", ", a AS (SELECT node_id, count(DISTINCT episode_id) AS episodes, max(occurred_at) AS newest FROM mention JOIN episode USING (episode_id) GROUP BY node_id) SELECT node_id, episodes, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest_at FROM a LEFT JOIN (SELECT concat('c', c_custkey) AS node_id, TIMESTAMP '2024-01-29 12:00:00' AS summary_at FROM customer WHERE c_custkey % 2 = 0) USING (node_id) WHERE episodes >= 5 AND (summary_at IS NULL OR newest > summary_at)", "mention", "episode")
def _(g):
    context = g.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), at("2024-01-29 12:00:00").alias("summary_at"))
    return shown(agg.stale_summaries(g.mention, g.episode, context, 5))
