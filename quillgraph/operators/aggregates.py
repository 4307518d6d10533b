"""Aggregations over the graph tables.  Each is one shuffle on its grouping key with map-side
combine; "now" is always the parameter `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..session import parts

CHANNELS = {"calendar.event": "meeting", "bee.conversation": "spoken", "email": "email", "sms": "message", "slack": "slack"}
#: Predicates of which a subject has one object at a time.
SINGLE_VALUED = ("assigned_to", "has_role", "located_in", "pursued_via", "works_at")


def channel(source: Column) -> Column:
    out = F.lit("other")
    for name, kind in CHANNELS.items():
        out = F.when(source == name, kind).otherwise(out)
    return out


def person_interactions(episode: DataFrame, mention: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """Per person the first and last interaction, their number and the last of each channel; what lies after `as_of` doesn't count."""
    people = nodes.where("node_type = 'person'").select("node_id")
    seen = mention.join(people, "node_id", "left_semi").join(episode.where(F.col("occurred_at") <= as_of), "episode_id")
    latest = F.struct("occurred_at", "episode_id")
    return seen.groupBy("node_id").agg(
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.count("*").alias("interactions"),
        F.max_by(channel(F.col("source")), latest).alias("last_channel"),
        F.max_by("episode_id", latest).alias("last_episode_id"),
        *[F.max(F.when(F.col("source") == s, F.col("occurred_at"))).alias(f"last_{c}_at") for s, c in CHANNELS.items()],
    )


def merge_interactions(rollup: DataFrame, delta: DataFrame) -> DataFrame:
    """The rollup after more interactions: both sides are partial aggregates of one kind."""
    latest = F.struct("last_at", "last_episode_id")
    return rollup.unionByName(delta).groupBy("node_id").agg(
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sum("interactions").alias("interactions"),
        F.max_by("last_channel", latest).alias("last_channel"),
        F.max_by("last_episode_id", latest).alias("last_episode_id"),
        *[F.max(f"last_{c}_at").alias(f"last_{c}_at") for c in CHANNELS.values()],
    )


def people_ranking(rollup: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k people with the most interactions; ties by node_id."""
    top = rollup.orderBy(F.desc("interactions"), "node_id").limit(k)
    return top.join(nodes.select("node_id", "name"), "node_id").select("node_id", "name", "interactions", "last_channel", "last_at")


def in_range(start: Column | None, end: Column | None) -> Column:
    """Half-open window on occurred_at; a missing side is open."""
    out = F.lit(True)
    if start is not None:
        out &= F.col("occurred_at") >= start
    if end is not None:
        out &= F.col("occurred_at") < end
    return out


def people_ranking_in_range(episode: DataFrame, mention: DataFrame, nodes: DataFrame, start: Column, end: Column, k: int) -> DataFrame:
    people = nodes.where("node_type = 'person'").select("node_id", "name")
    seen = mention.join(episode.where(in_range(start, end)).select("episode_id"), "episode_id").groupBy("node_id").agg(F.countDistinct("episode_id").alias("interactions"))
    return seen.join(people, "node_id").orderBy(F.desc("interactions"), "node_id").limit(k)


def source_coverage(episode: DataFrame, mention: DataFrame, node_id: str) -> DataFrame:
    mine = mention.where(F.col("node_id") == node_id).select("episode_id").distinct()
    by = episode.join(mine, "episode_id", "left_semi").groupBy("source")
    return by.agg(F.count("*").alias("n"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def entity_source_counts(episode: DataFrame, mention: DataFrame, start: Column, end: Column) -> DataFrame:
    seen = mention.select("episode_id", "node_id").distinct().join(episode.where(in_range(start, end)), "episode_id")
    return seen.groupBy("node_id", "source").agg(F.count("*").alias("n"))


def source_counts(episode: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return episode.where(in_range(start, end)).groupBy("source").agg(F.count("*").alias("n"))


def known_sources(episode: DataFrame) -> DataFrame:
    return episode.select("source").distinct()


def list_tags(annotation: DataFrame) -> DataFrame:
    return annotation.where("kind = 'tag'").groupBy(F.col("body").alias("tag")).agg(F.count("*").alias("n"))


def class_history(candidate: DataFrame) -> DataFrame:
    """Accepted and rejected candidates of each (proposer, predicate), and the Wilson lower bound."""
    by = candidate.where("status <> 'proposed'").groupBy("proposer", "predicate")
    counts = by.agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count("*").alias("judged"))
    return counts.withColumn("lower_bound", fn.wilson_lower_bound(F.col("accepted").cast("double"), F.col("judged").cast("double")))


def accept_streak(candidate: DataFrame) -> DataFrame:
    """Acceptances of each class after its last rejection."""
    last = F.max(F.when(F.col("status") == "rejected", F.col("reviewed_at"))).over(Window.partitionBy("proposer", "predicate"))
    judged = candidate.where("status <> 'proposed'").withColumn("last_reject", last)
    after = F.col("last_reject").isNull() | (F.col("reviewed_at") > F.col("last_reject"))
    return judged.groupBy("proposer", "predicate").agg(F.count_if((F.col("status") == "accepted") & after).alias("streak"))


def verdict_scorecard(verdict: DataFrame) -> DataFrame:
    return verdict.groupBy("verdict", F.coalesce("outcome", F.lit("pending")).alias("outcome")).agg(F.count("*").alias("n"))


def live_contradictions(fact: DataFrame) -> DataFrame:
    """Subjects with several live positive objects of a single-valued predicate."""
    live = fact.where(fn.is_live() & (F.col("polarity") == "positive") & F.col("predicate").isin(*SINGLE_VALUED))
    return live.groupBy("subject_id", "predicate").agg(F.countDistinct("object_id").alias("n_objects")).where("n_objects > 1")


def unique_names(nodes: DataFrame, alias: DataFrame, least: int = 3) -> DataFrame:
    """(name, node_id) of names that mean one node only; titles of events and documents aren't names."""
    both = nodes.where(~F.col("node_type").isin(*fn.ANCHOR_LAST)).select("node_id", fn.canonicalize(F.col("name")).alias("name")).union(alias.select("node_id", F.col("alias").alias("name"))).distinct()
    one = both.where(F.char_length("name") >= least).groupBy("name").agg(F.min("node_id").alias("node_id"), F.countDistinct("node_id").alias("n"))
    return one.where("n = 1").select("name", "node_id")


def staleness_clock(fact: DataFrame, observation: DataFrame, episode: DataFrame) -> DataFrame:
    """The newest evidence of each fact: of its supporting observations, the episode's time or else the observation's; without any, when it began to hold or was ingested."""
    seen = observation.where(F.col("kind").isin("asserted", "corroborated", "verified")).select("fact_id", "episode_id", "observed_at")
    n = parts(observation)
    # observations without an episode have no partner, and would all meet in one task
    dated = seen.where("episode_id IS NOT NULL").repartition(n, "episode_id").join(episode.select("episode_id", "occurred_at").repartition(n, "episode_id"), "episode_id", "left")
    every = dated.select("fact_id", F.coalesce("occurred_at", "observed_at").alias("at")).union(seen.where("episode_id IS NULL").select("fact_id", "observed_at"))
    newest = every.repartition(n, "fact_id").groupBy("fact_id").agg(F.max("at").alias("evidence_at"))
    return fact.repartition(n, "fact_id").join(newest, "fact_id", "left").withColumn("seen_at", F.coalesce("evidence_at", "valid_from", "ingested_at"))


def stale_facts(fact: DataFrame, observation: DataFrame, episode: DataFrame, half_lives: DataFrame, as_of: Column) -> DataFrame:
    """Live facts whose predicate's decay rate (per year) times their age exceeds ln 2."""
    clock = staleness_clock(fact.where(fn.is_live()), observation, episode).join(half_lives, "predicate")
    age = fn.days_between(as_of, F.col("seen_at")) / 365.25
    return clock.withColumn("age_years", age).where((F.col("decay") > 0) & (F.col("decay") * F.col("age_years") > fn.LN2))


def strictest_sensitivity(contributors: DataFrame, key: str) -> DataFrame:
    return contributors.groupBy(key).agg(fn.tier_of(F.max(fn.sensitivity_rank(F.col("sensitivity")))).alias("sensitivity"))


def centroids(vector: DataFrame, least: int = 1) -> DataFrame:
    """(node_id, n, centroid): mean vector of a node's episodes, by position, in double."""
    parts = vector.select("node_id", "episode_id", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("node_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.countDistinct("episode_id").alias("n"))
    by = means.groupBy("node_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    return by.where(F.col("n") >= least)


def review_clusters(candidate: DataFrame, sample: int) -> DataFrame:
    """Pending candidates by class with a sample spread evenly over each class's confidence order."""
    pending = candidate.where("status = 'proposed'")
    w = Window.partitionBy("proposer", "predicate", "kind")
    ranked = pending.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(F.desc("confidence"), "candidate_id")) - 1})
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / sample))
    picked = (F.col("rn") % stride == 0) & (F.col("rn") / stride < sample)
    return ranked.groupBy("proposer", "predicate", "kind").agg(
        F.count("*").alias("pending"),
        F.min("confidence").alias("least_confidence"),
        F.max("confidence").alias("most_confidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(picked, F.struct("rn", "candidate_id")))), lambda s: s["candidate_id"].cast("string")), ",").alias("sample_ids"),
    )


def recurring_subjects(candidate: DataFrame, names: DataFrame, least: int = 3, stop: tuple[str, ...] = ("he", "i", "it", "she", "that", "they", "this", "we", "you")) -> DataFrame:
    """Subjects of pending candidates that recur, have at most five words and name nothing known."""
    subject = fn.canonicalize(F.col("subject")).alias("subject")
    counted = candidate.where("status = 'proposed' AND kind = 'fact'").select(subject).groupBy("subject").agg(F.count("*").alias("n"))
    apt = counted.where((F.col("n") >= least) & (F.size(F.split("subject", r"\s+")) <= 5) & ~F.col("subject").isin(*stop) & (F.col("subject") != ""))
    return apt.join(names.select(F.col("name").alias("subject")), "subject", "left_anti")


def health(episode: DataFrame, nodes: DataFrame, mention: DataFrame, fact: DataFrame, candidate: DataFrame, vector: DataFrame) -> DataFrame:
    """One row of counters; each is one aggregate, joined as single rows."""
    live = fact.where(fn.is_live())
    connected = live.select(F.col("subject_id").alias("node_id")).union(live.select("object_id")).union(mention.select("node_id")).distinct()
    parts = [
        episode.agg(F.count("*").alias("episodes"), F.countDistinct("source").alias("sources"), F.count_if(~F.col("sensitivity").isin(*fn.SHOWN)).alias("hidden_episodes")),
        nodes.agg(F.count("*").alias("nodes")),
        nodes.join(connected, "node_id", "left_anti").agg(F.count("*").alias("isolated")),
        mention.agg(F.count("*").alias("mentions"), F.countDistinct("episode_id").alias("mentioned_episodes")),
        fact.agg(F.count("*").alias("facts"), F.count_if(fn.is_live()).alias("live_facts"), F.count_if(F.col("invalidated_at").isNotNull()).alias("invalidated_facts")),
        candidate.agg(F.count_if(F.col("status") == "proposed").alias("pending")),
        vector.agg(F.count("*").alias("vectors")),
        live_contradictions(fact).agg(F.count("*").alias("contradictions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    return out.withColumn("isolated_percent", F.round(100.0 * F.col("isolated") / F.greatest(F.col("nodes"), F.lit(1)), 4))


def observation_counts(observation: DataFrame) -> DataFrame:
    return observation.groupBy("fact_id", "kind").agg(F.count("*").alias("n"))


def evaluation(hits: DataFrame) -> DataFrame:
    """Per job recall within 10 and mean reciprocal rank of (job, query, rank); a null rank is a miss."""
    rank = F.col("rank").cast("double")
    return hits.groupBy("job").agg(
        F.count("*").alias("queries"), F.avg(F.coalesce((rank <= 10).cast("double"), F.lit(0.0))).alias("recall_at_10"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr")
    )


def stale_summaries(mention: DataFrame, episode: DataFrame, context: DataFrame, least: int) -> DataFrame:
    """Nodes with `least` episodes at least, and evidence newer than their summary or no summary."""
    active = mention.join(episode.select("episode_id", "occurred_at"), "episode_id").groupBy("node_id").agg(F.countDistinct("episode_id").alias("episodes"), F.max("occurred_at").alias("newest_at"))
    old = F.col("summary_at").isNull() | (F.col("newest_at") > F.col("summary_at"))
    return active.where(F.col("episodes") >= least).join(context, "node_id", "left").where(old).select("node_id", "episodes", "newest_at")
