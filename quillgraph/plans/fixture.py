"""The test tables seen as a personal knowledge graph.

Each graph table is one SELECT in SQL that Spark and other engines read alike, so that a query and
its oracle start from the same rows.  `{name}` stands for a source table or an earlier fixture.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..session import parts, table

SQL: dict[str, str] = {
    "episode": """
SELECT event_id AS episode_id,
  CASE event_type WHEN 'purchase' THEN 'calendar.event' WHEN 'click' THEN 'bee.conversation' WHEN 'view' THEN 'email'
    WHEN 'signup' THEN 'sms' ELSE 'slack' END AS source,
  concat('ev', event_id) AS source_id, concat('entry ', event_type, ' ', props) AS body, ts AS occurred_at,
  CASE event_type WHEN 'purchase' THEN ts + INTERVAL 1 HOUR WHEN 'click' THEN ts + INTERVAL 30 MINUTE END AS occurred_end,
  CASE event_id % 10 WHEN 9 THEN 'secret' WHEN 8 THEN 'private' WHEN 7 THEN 'personal' ELSE 'public' END AS sensitivity
FROM {events}""",
    "nodes": """
SELECT concat('c', c_custkey) AS node_id, 'person' AS node_type, c_name AS name, CAST(c_custkey % 7 AS INT) AS access_count FROM {customer}
UNION ALL SELECT concat('s', s_suppkey), 'org', s_name, CAST(s_suppkey % 5 AS INT) FROM {supplier}
UNION ALL SELECT concat('p', p_partkey), 'topic', p_name, CAST(p_partkey % 3 AS INT) FROM {part}
UNION ALL SELECT concat('n', n_nationkey), 'place', n_name, n_nationkey FROM {nation}
UNION ALL SELECT concat('r', r_regionkey), 'place', r_name, r_regionkey FROM {region}""",
    "mention": """
SELECT event_id AS episode_id, concat('c', user_id) AS node_id, 'deterministic' AS extractor, 1.0E0 AS confidence FROM {events}
UNION ALL SELECT event_id, concat('c', (user_id * 7 + 3) % 100), 'alias', 0.8E0 FROM {events} WHERE event_id % 3 = 0""",
    "basket": """
SELECT DISTINCT l_orderkey AS episode_id, concat('p', l_partkey) AS node_id FROM {lineitem}""",
    "fact": """
SELECT concat('fo', o_orderkey) AS fact_id, concat('c', o_custkey) AS subject_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'works_at' WHEN 1 THEN 'reports_to' WHEN 2 THEN 'has_role' WHEN 3 THEN 'knows' ELSE 'located_in' END AS predicate,
  CASE o_orderkey % 5 WHEN 3 THEN concat('c', (o_custkey * 13 + o_orderkey) % 100) WHEN 4 THEN concat('n', o_orderkey % 25) ELSE concat('s', o_orderkey % 10) END AS object_id, CAST(NULL AS STRING) AS object_value,
  concat('claim ', o_orderpriority, ' by ', o_custkey) AS statement, o_orderdate AS valid_from,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS valid_to,
  o_orderdate AS ingested_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 10 DAY END AS invalidated_at,
  0.5E0 + (o_orderkey % 50) / 100.0E0 AS confidence, CASE WHEN o_orderkey % 11 = 0 THEN 'negative' ELSE 'positive' END AS polarity,
  CASE o_orderkey % 7 WHEN 6 THEN 'private' WHEN 5 THEN 'personal' ELSE 'public' END AS sensitivity,
  CASE o_orderkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'probe:a' WHEN 2 THEN 'linker:npmi' ELSE 'extract:m' END AS extractor,
  CAST(1 + o_orderkey % 5 AS INT) AS observations, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 1000 END AS episode_id
FROM {orders}""",
    "observation": """
SELECT concat('fo', l_orderkey) AS fact_id, l_orderkey * 10 + l_linenumber AS observation_id,
  CASE l_linenumber % 4 WHEN 1 THEN 'asserted' WHEN 2 THEN 'corroborated' WHEN 3 THEN 'verified' ELSE 'disputed' END AS kind,
  CASE l_returnflag WHEN 'A' THEN 'user' WHEN 'N' THEN 'extract:m' ELSE 'linker:npmi' END AS method,
  CASE WHEN l_linenumber % 3 <> 0 THEN (l_orderkey * 7 + l_linenumber) % 1000 END AS episode_id, l_shipdate AS observed_at, 1.0E0 - l_discount * 2 AS confidence
FROM {lineitem}""",
    "candidate": """
SELECT d.doc_id AS candidate_id, concat('extract:', d.source) AS proposer, concat('spoke_', d.lang) AS predicate, concat('Person ', d.doc_id % 40) AS subject,
  lower(substr(d.text, 1, 40)) AS statement, 0.3E0 + (d.doc_id % 60) / 100.0E0 AS confidence,
  CASE WHEN l.doc_id IS NULL THEN 'proposed' WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id * 2 END AS reviewed_at, CASE d.doc_id % 17 WHEN 0 THEN 'commitment' ELSE 'fact' END AS kind
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "task": """
SELECT concat('t', o_orderkey) AS node_id, concat('task ', o_orderkey) AS name,
  CASE o_orderkey % 6 WHEN 0 THEN 'inbox' WHEN 1 THEN 'next' WHEN 2 THEN 'waiting' WHEN 3 THEN 'scheduled' WHEN 4 THEN 'someday' ELSE 'done' END AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS due_at, concat('s', o_orderkey % 100) AS project_id, o_orderkey AS created
FROM {orders}""",
    "vector": """
SELECT vec_id AS episode_id, concat('k', label) AS node_id, embedding FROM {embeddings}""",
}
SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Graph:
    """The graph tables of a data folder, by attribute, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCES:
            found = table(self.spark, self.sf_dir, name)
        elif name in SQL:
            needed = {s: getattr(self, s) for s in SOURCES if "{" + s + "}" in SQL[name]}
            if name == "basket":  # each order in one of many partitions, so that no task holds much of the distinct rows
                rows = needed["lineitem"].select("l_orderkey", "l_partkey")
                needed["lineitem"] = rows.repartition(parts(rows), "l_orderkey")
            found = self.spark.sql(SQL[name], **needed)
        else:
            raise AttributeError(name)
        self.__dict__[name] = found
        return found


@cache
def with_fixtures(*names: str) -> str:
    """The WITH clause that defines fixtures for an engine in which the sources are views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].format(**{s: s for s in SOURCES})})" for n in names)
