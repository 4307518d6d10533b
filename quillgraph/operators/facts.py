"""The life of a fact: assertion, closure, confidence, reading by time, triage and repair.

Writes are deltas: each function takes the table and returns the new one, or the rows that change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..session import parts
from .aggregates import SINGLE_VALUED
from .link import are_few, npmi, pair_counts, shared_counts


def claims_on(fact: DataFrame, incoming: DataFrame, episode: DataFrame | None = None) -> DataFrame:
    """`incoming` with fact_id, whether that fact is live already, the claim's tier and whether an agent made it.

    A claim (subject_id, predicate, object_id, object_value, polarity, ...) is about the live fact of
    the same subject, predicate, object and polarity; a missing literal fits any, the equal one first
    and then the least fact_id.  Within the batch a claim without a literal joins the least one.  New
    facts are named after their claim and its first time.  With `episode` the tier is that of the
    claim's episode (``personal`` without any) and agents are its sources; else both are the claim's.
    """
    key = ["subject_id", "predicate", "object_id", "polarity"]
    rows = incoming if "object_value" in incoming.columns else incoming.withColumn("object_value", F.lit(None).cast("string"))
    rows = rows.withColumn("literal", F.coalesce("object_value", F.min("object_value").over(Window.partitionBy(*key))))
    if episode is not None:
        seen = episode.select("episode_id", F.col("sensitivity").alias("tier"), F.col("source").alias("origin"))
        rows = rows.join(seen, "episode_id", "left").withColumns({"tier": F.coalesce("tier", F.lit("personal")), "by_agent": F.coalesce(fn.is_agent(F.col("origin")), F.lit(False))}).drop("origin")
    else:
        rows = rows.withColumns({"tier": F.col("sensitivity"), "by_agent": F.coalesce(fn.is_agent(F.col("extractor")), F.lit(False))})
    groups = rows.groupBy(*key, "literal").agg(F.min("at").alias("first_at"))
    live = fact.where(fn.is_live()).select(*[F.col(c).alias(f"f_{c}") for c in (*key, "object_value")], F.col("fact_id").alias("hit"))
    fits = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in key]) & (F.col("literal").isNull() | F.col("f_object_value").isNull() | (F.col("literal") == F.col("f_object_value")))
    best = F.min_by("hit", F.struct(~F.col("literal").eqNullSafe(F.col("f_object_value")), F.col("hit")))
    found = groups.join(live, fits, "left").groupBy(*key, "literal").agg(best.alias("hit"), F.min("first_at").alias("first_at"))
    made = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in (*key, "literal")], F.col("first_at").cast("string")), 256)
    found = found.select(*[F.col(c).alias(f"g_{c}") for c in (*key, "literal")], F.coalesce("hit", made).alias("fact_id"), F.col("hit").isNotNull().alias("known"))
    return rows.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in (*key, "literal")])).drop(*[f"g_{c}" for c in (*key, "literal")])


def assert_facts(fact: DataFrame, incoming: DataFrame, episode: DataFrame | None = None, observation: DataFrame | None = None) -> DataFrame:
    """`fact` after a batch of claims; see :func:`claims_on`.

    A claim about a live fact corroborates it: its tier rises to the strictest, and its count by each
    episode that it hasn't been seen in (by `observation` and its own) and that isn't an agent's, and by
    each claim without episode.  Others are new facts: the earliest of equal claims founds one.
    """
    rows = claims_on(fact, incoming, episode)
    seen = fact.select("fact_id", "episode_id")
    if observation is not None:
        seen = seen.union(observation.select("fact_id", "episode_id"))
    seen = seen.where("episode_id IS NOT NULL").distinct().withColumn("seen", F.lit(True))
    counted = rows.withColumn("first", F.row_number().over(Window.partitionBy("fact_id").orderBy("at", "statement", F.col("episode_id").asc_nulls_last())) == 1)
    counted = counted.join(seen, ["fact_id", "episode_id"], "left")
    founder = F.when(~F.col("known") & F.col("first"), F.col("episode_id"))
    fresh = F.when(~F.col("by_agent") & F.col("seen").isNull(), F.col("episode_id"))
    by = counted.groupBy("fact_id").agg(
        F.first("known").alias("known"), F.countDistinct(fresh).alias("episodes"), F.count_if(F.col("episode_id").isNull()).alias("loose"),
        F.max(F.col("first") & ~F.col("known") & (F.col("episode_id").isNull() | ~F.col("by_agent"))).cast("int").alias("own"),
        F.max(fn.sensitivity_rank(F.col("tier"))).alias("rank"), F.min("at").alias("c_at"), F.max("confidence").alias("c_confidence"), F.max(founder).alias("c_episode_id"),
        F.min_by("statement", F.struct("at", "statement")).alias("c_statement"), F.min_by("extractor", F.struct("at", "statement", "extractor")).alias("c_extractor"),
        *[F.first(c).alias(c) for c in ("subject_id", "predicate", "object_id", "polarity", "literal")],
    )
    bump = by.where("known").select("fact_id", (F.col("episodes") + F.col("loose")).alias("more"), F.col("rank").alias("c_rank"))
    both = fact.join(bump, "fact_id", "left")
    tier = F.when(F.col("c_rank") > fn.sensitivity_rank(F.col("sensitivity")), fn.tier_of(F.col("c_rank"))).otherwise(F.col("sensitivity"))
    kept = both.withColumns({"observations": (F.col("observations") + F.coalesce("more", F.lit(0))).cast("int"), "sensitivity": tier}).select(*fact.columns)
    made = {
        "object_value": F.col("literal"), "statement": F.col("c_statement"), "valid_from": F.col("c_at"), "ingested_at": F.col("c_at"), "confidence": F.col("c_confidence"), "sensitivity": fn.tier_of(F.col("rank")),
        "extractor": F.col("c_extractor"), "episode_id": F.col("c_episode_id"), "observations": 1 + F.col("episodes") + F.col("loose") - F.col("own"), "valid_to": F.lit(None), "invalidated_at": F.lit(None),
    }
    new = by.where("NOT known").select(*[made.get(c, F.col(c)).cast(fact.schema[c].dataType).alias(c) for c in fact.columns])
    return kept.unionByName(new)


def observations_of(fact: DataFrame, incoming: DataFrame, episode: DataFrame | None = None) -> DataFrame:
    """The observation of each claim of a batch: asserted where it founds a fact, else corroborated."""
    rows = claims_on(fact, incoming, episode)
    first = F.row_number().over(Window.partitionBy("fact_id").orderBy("at", "statement", F.col("episode_id").asc_nulls_last())) == 1
    kind = F.when(~F.col("known") & first, "asserted").otherwise("corroborated")
    number = F.xxhash64("fact_id", "episode_id", F.col("at").cast("string"), "extractor", "statement")
    return rows.select("fact_id", number.alias("observation_id"), kind.alias("kind"), F.col("extractor").alias("method"), "episode_id", F.col("at").alias("observed_at"), "confidence")


def close(fact: DataFrame, ids: DataFrame, how: str, at: Column) -> DataFrame:
    """`fact` with the given ids closed: ``supersede`` ends validity and belief, ``decay`` validity
    only, ``never_true`` belief, with a validity of no length."""
    hit = fact.join(ids.select(F.col("fact_id").alias("_id")).distinct(), F.col("fact_id") == F.col("_id"), "left")
    now = F.col("_id").isNotNull() & fn.is_live()
    to = {"supersede": at, "decay": at, "never_true": F.coalesce("valid_from", at)}[how]
    gone = at if how != "decay" else F.col("invalidated_at")
    changed = hit.withColumns({"valid_to": F.when(now, to).otherwise(F.col("valid_to")), "invalidated_at": F.when(now, gone).otherwise(F.col("invalidated_at"))})
    return changed.drop("_id")


def confidences(fact: DataFrame, observation: DataFrame, candidate_rates: DataFrame) -> DataFrame:
    """(fact_id, posterior): mean of a Beta posterior of each fact.

    Prior: (19, 1) where a user verified it; else the acceptance rate of its (proposer,
    predicate) with strength 10 when at least five were judged; else its founding confidence with
    that strength; else (1, 1).  Supports are distinct episodes that aren't an aggregate method's,
    and supporting observations without episode.
    """
    support = F.col("kind").isin("asserted", "corroborated", "verified") & ~fn.is_aggregate_method(F.col("method"))
    by = observation.groupBy("fact_id").agg(
        F.countDistinct(F.when(support, F.col("episode_id"))).alias("episodes"),
        F.count_if(support & F.col("episode_id").isNull()).alias("loose"),
        F.count_if(F.col("kind") == "disputed").alias("disputes"),
        F.max((F.col("kind") == "verified") & (F.col("method") == "user")).alias("verified"),
        F.min_by("confidence", F.struct("observation_id", "confidence")).alias("founding"),
    )
    rates = candidate_rates.where("judged >= 5").select(F.col("proposer").alias("extractor"), "predicate", (F.col("accepted") / F.col("judged")).alias("rate"))
    f = fact.select("fact_id", "extractor", "predicate").join(by, "fact_id", "left").join(rates, ["extractor", "predicate"], "left")
    rate = fn.beta_from_rate(F.col("rate"))
    founding = fn.beta_from_rate(F.col("founding"))
    alpha = F.when(F.col("verified"), 19.0).when(F.col("rate").isNotNull(), rate[0]).when(F.col("founding").isNotNull(), founding[0]).otherwise(1.0)
    beta = F.when(F.col("verified"), 1.0).when(F.col("rate").isNotNull(), rate[1]).when(F.col("founding").isNotNull(), founding[1]).otherwise(1.0)
    s = F.coalesce(F.col("episodes") + F.col("loose"), F.lit(0))
    return f.select("fact_id", fn.posterior_mean(alpha, beta, s, F.coalesce("disputes", F.lit(0))).alias("posterior"))


def fact_by_id(fact: DataFrame, fact_id: str) -> DataFrame:
    return fact.where(F.col("fact_id") == fact_id)


def user_verified(observation: DataFrame) -> DataFrame:
    """(fact_id) of the facts that the user verified."""
    return observation.where("kind = 'verified' AND method = 'user'").select("fact_id").distinct()


def facts_for_node(fact: DataFrame, node_id: str) -> DataFrame:
    return fact.where((F.col("subject_id") == node_id) | (F.col("object_id") == node_id)).where(fn.is_live())


def facts_as_of(fact: DataFrame, t: Column) -> DataFrame:
    return fact.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def timeline(fact: DataFrame, node_id: str, start: Column | None = None, end: Column | None = None, k: int = 50) -> DataFrame:
    out = fact.where((F.col("subject_id") == node_id) & F.col("valid_from").isNotNull())
    if start is not None:
        out = out.where(F.col("valid_from") >= start)
    if end is not None:
        out = out.where(F.col("valid_from") < end)
    return out.orderBy("valid_from", "fact_id").limit(k)


def normalize_predicates(rows: DataFrame, vocabulary: DataFrame, alias: DataFrame) -> DataFrame:
    """`rows` with `canonical` added: the alias's predicate, else a known one, else the only known
    one of the same stem, else the predicate as it is."""
    p = F.regexp_replace(fn.canonicalize(F.col("predicate")), r"[\s-]+", "_")
    out = rows.withColumn("_p", p)
    out = out.join(alias.select(F.col("alias").alias("_p"), F.col("predicate").alias("_by_alias")), "_p", "left")
    out = out.join(vocabulary.select(F.col("predicate").alias("_p"), F.col("predicate").alias("_known")), "_p", "left")
    stems = vocabulary.select(fn.stem_predicate(F.col("predicate")).alias("_stem"), "predicate").groupBy("_stem").agg(F.min("predicate").alias("_by_stem"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = out.withColumn("_stem", fn.stem_predicate(F.col("_p"))).join(stems, "_stem", "left")
    return out.withColumn("canonical", F.coalesce("_by_alias", "_known", "_by_stem", "_p")).drop("_p", "_by_alias", "_known", "_by_stem", "_stem")


def duplicate_facts(fact: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.97) -> DataFrame:
    """(keep, drop): live facts of one subject that say the same; the more observed stays, then the newer.

    Equal normalised statements, or with `vectors` (fact_id, embedding) a cosine of at least
    `threshold`.  Pairs are made within a subject.
    """
    live = fact.where(fn.is_live()).select("fact_id", "subject_id", "polarity", fn.normalize(F.col("statement")).alias("said"), "observations", "ingested_at")
    if vectors is not None:
        live = live.join(vectors, "fact_id", "left")
    a, b = live.alias("a"), live.alias("b")
    same = F.col("a.said") == F.col("b.said")
    if vectors is not None:
        same |= F.coalesce(fn.cosine(F.col("a.embedding"), F.col("b.embedding")) >= threshold, F.lit(False))
    better = F.struct("a.observations", "a.ingested_at", "a.fact_id") > F.struct("b.observations", "b.ingested_at", "b.fact_id")
    on = (F.col("a.subject_id") == F.col("b.subject_id")) & (F.col("a.polarity") == F.col("b.polarity")) & better & same
    return a.join(b, on).select(F.col("a.fact_id").alias("keep"), F.col("b.fact_id").alias("drop"))


def ladder(history: DataFrame, demotion: DataFrame | None = None, sampled: float = 0.65, trusted: float = 0.85) -> DataFrame:
    """(proposer, predicate, rung) after a class's verdicts (proposer, predicate, seq, accepted) by reviewers.

    An acceptance moves a class one rung up where the Wilson bound of all its verdicts so far reaches
    the next rung's floor; a rejection counts in that bound and moves nothing.  Only a `demotion`
    (proposer, predicate, seq) takes a class back to staged; its verdicts stay counted.
    """
    key = ["proposer", "predicate"]
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    low = fn.wilson_lower_bound(F.count_if("accepted").over(w).cast("double"), F.count("*").over(w).cast("double"))
    h = history.withColumn("low", low)
    classes = history.select(*key)
    if demotion is not None:
        last = demotion.groupBy(*key).agg(F.max("seq").alias("last"))
        h = h.join(last, key, "left").where("last IS NULL OR seq > last")
        classes = classes.union(last.select(*key))
    first = F.min(F.when(F.col("accepted") & (F.col("low") >= sampled), F.col("seq"))).over(Window.partitionBy(*key))
    up = h.withColumn("first", first).groupBy(*key).agg(F.max("first").alias("first"), F.max(F.col("accepted") & (F.col("low") >= trusted) & (F.col("seq") > F.col("first"))).alias("top"))
    rung = F.when(F.col("top"), "trusted").when(F.col("first").isNotNull(), "sampled").otherwise("staged")
    return classes.distinct().join(up, key, "left").select(*key, rung.alias("rung"))


#: Verdicts of the verifier, the gravest first.
VERDICTS = ("missing", "refuted", "contradicted", "denied", "stale", "residue", "unrooted", "unverifiable", "rederived", "supported")


def verdicts(fact: DataFrame, observation: DataFrame, episode: DataFrame, nodes: DataFrame, mention: DataFrame, stale: DataFrame, least_co: int = 3, threshold: float = 0.3) -> DataFrame:
    """(fact_id, verdict, n_cited, n_alive, n_supporting) of every fact.

    In this order: a closed fact is missing; another live object of a single-valued predicate
    contradicts it; a live negation of its subject and predicate denies it; it may be stale; one that
    was computed from co-occurrence is computed again, rederived or refuted; one that cites no episode
    is unrooted, one of which all are gone unverifiable; it's supported where an episode that it cites
    has the words of its object or literal, and else residue, which needs a reader.
    """
    n = parts(observation)
    backing = observation.where(F.col("kind").isin("asserted", "corroborated", "verified") & F.col("episode_id").isNotNull()).select("fact_id", "episode_id")
    cited = fact.where("episode_id IS NOT NULL").select("fact_id", "episode_id").union(backing).repartition(n, "fact_id").distinct()
    sought = fact.select("fact_id", "object_id", "object_value").join(nodes.select(F.col("node_id").alias("object_id"), F.col("name").alias("object_name")), "object_id", "left")
    sought = sought.select("fact_id", F.when(F.col("object_id").isNotNull(), F.col("object_name")).otherwise(F.col("object_value")).alias("sought"))
    named = cited.join(sought.repartition(n, "fact_id"), "fact_id").repartition(n, "episode_id")
    read = named.join(episode.select("episode_id", "body").repartition(n, "episode_id"), "episode_id", "left")
    read = read.select("fact_id", F.col("body").isNotNull().alias("alive"), fn.lexically_supports(F.col("body"), F.col("sought")).alias("supports")).repartition(n, "fact_id")
    trail = read.groupBy("fact_id").agg(F.count("*").alias("n_cited"), F.count_if("alive").alias("n_alive"), F.count_if("supports").alias("n_supporting"))
    live = fact.where(fn.is_live())
    positive = live.where("polarity = 'positive'")
    rivals = positive.where(F.col("predicate").isin(*SINGLE_VALUED) & F.col("object_id").isNotNull()).groupBy("subject_id", "predicate").agg(F.count("*").alias("rivals"))
    denials = live.where("polarity = 'negative'").groupBy("subject_id", "predicate").agg(F.count("*").alias("denials"))
    computed = fact.where("extractor = 'npmi' AND object_id IS NOT NULL").select("fact_id", F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b"))
    pairs = pair_counts(mention, least_co, computed)
    pairs = pairs.select("a", "b", npmi(F.col("co"), F.col("n_a"), F.col("n_b"), F.col("universe")).alias("npmi"))
    computed = computed.join(pairs, ["a", "b"], "left").select("fact_id", F.coalesce(F.col("npmi") >= threshold, F.lit(False)).alias("holds"))
    f = fact.repartition(n, "fact_id").join(trail, "fact_id", "left").join(rivals, ["subject_id", "predicate"], "left").join(denials, ["subject_id", "predicate"], "left").join(computed, "fact_id", "left")
    f = f.join(stale.select("fact_id", F.lit(True).alias("stale")).distinct(), "fact_id", "left")
    n_cited, n_alive, n_supporting = (F.coalesce(c, F.lit(0)) for c in ("n_cited", "n_alive", "n_supporting"))
    is_positive = F.col("polarity") == "positive"
    others = F.coalesce("rivals", F.lit(0)) - is_positive.cast("int")
    verdict = (
        F.when(~fn.is_live(), "missing")
        .when(F.col("predicate").isin(*SINGLE_VALUED) & F.col("object_id").isNotNull() & (others > 0), "contradicted")
        .when(is_positive & (F.col("denials") > 0), "denied")
        .when(F.col("stale"), "stale")
        .when(F.col("holds").isNotNull(), F.when(F.col("holds"), "rederived").otherwise("refuted"))
        .when(n_cited == 0, "unrooted")
        .when(n_alive == 0, "unverifiable")
        .when(n_supporting > 0, "supported")
        .otherwise("residue")
    )
    return f.select("fact_id", "subject_id", "polarity", "observations", "ingested_at", verdict.alias("verdict"), n_cited.alias("n_cited"), n_alive.alias("n_alive"), n_supporting.alias("n_supporting"))


def node_report(checked: DataFrame, node_id: str, k: int) -> DataFrame:
    """The verdicts on a node's live positive facts, the gravest first, then the least observed and the newest."""
    grave = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    own = checked.where((F.col("subject_id") == node_id) & (F.col("polarity") == "positive") & (F.col("verdict") != "missing"))
    return own.orderBy(grave, "observations", F.desc("ingested_at"), "fact_id").limit(k)


def npmi_decay(claims: DataFrame, mention: DataFrame, drift: float = 0.01, collapse: float = 0.5, floor: float = 0.24, cap: int = 40) -> DataFrame:
    """(fact_id, stated, now, action) of co-occurrence claims (fact_id, a, b, stated) whose value has moved.

    alarm: under half of what was stated; close: under the floor, or no shared episodes left to
    compute it from; rewrite: drifted.  At most `cap`, the most drifted first.
    """
    claimed = claims.select("fact_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "stated")
    pairs = pair_counts(mention, 1, claimed, are_few(claimed)).select("a", "b", npmi(F.col("co"), F.col("n_a"), F.col("n_b"), F.col("universe")).alias("now"))
    c = claimed.join(pairs, ["a", "b"], "left")
    action = F.when(F.col("now").isNull(), "close").when(F.col("now") < floor, "close").when(F.col("now") < collapse * F.col("stated"), "alarm").when(F.abs(F.col("now") - F.col("stated")) > drift, "rewrite")
    moved = c.withColumn("action", action).where("action IS NOT NULL")
    return moved.orderBy(F.desc(F.round(F.abs(F.coalesce("now", F.lit(0.0)) - F.col("stated")), 9)), "fact_id").limit(cap).select("fact_id", "stated", "now", "action")


def phantoms(claims: DataFrame, mention: DataFrame) -> DataFrame:
    """Co-occurrence claims whose nodes share no episode at all."""
    claimed = claims.select("fact_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return claimed.join(shared_counts(mention, 1, claimed, are_few(claimed)), ["a", "b"], "left_anti").select("fact_id")


def probe_targets(nodes: DataFrame, slots: DataFrame, fact: DataFrame, touches: DataFrame, stale: DataFrame, k: int = 200) -> DataFrame:
    """(node_id, missing, stale, score): what to ask about: ln(1 + touches) times missing slots and stale facts."""
    wanted = nodes.select("node_id", "node_type").join(slots.where("required"), "node_type")
    have = fact.where(fn.is_live()).select(F.col("subject_id").alias("node_id"), F.col("predicate").alias("slot")).distinct()
    missing = wanted.join(have, ["node_id", "slot"], "left_anti").groupBy("node_id").agg(F.count("*").alias("missing"))
    old = stale.groupBy(F.col("subject_id").alias("node_id")).agg(F.count("*").alias("stale"))
    both = touches.join(missing, "node_id", "left").join(old, "node_id", "left").na.fill(0, ["missing", "stale"])
    scored = both.withColumn("score", F.log(1.0 + F.col("touches")) * (F.col("missing") + F.col("stale"))).where("score > 0")
    return scored.orderBy(F.desc(F.round("score", 9)), "node_id").limit(k).select("node_id", "missing", "stale", "score")


def queue_duplicates(candidate: DataFrame) -> DataFrame:
    """(candidate_id, rank): the order within candidates of one subject and statement; 1 stays."""
    w = Window.partitionBy(fn.normalize(F.col("subject")), fn.normalize(F.col("statement"))).orderBy(F.desc("confidence"), F.desc("candidate_id"))
    return candidate.where("status = 'proposed'").select("candidate_id", F.row_number().over(w).alias("rank"))


def pending(candidate: DataFrame, k: int, proposer: str | None = None, predicate: str | None = None, least: float | None = None, text: str | None = None, most: float | None = None) -> DataFrame:
    out = candidate.where("status = 'proposed'")
    if proposer is not None:
        out = out.where(F.contains("proposer", F.lit(proposer)))
    if predicate is not None:
        out = out.where(F.col("predicate") == predicate)
    if least is not None:
        out = out.where(F.col("confidence") >= least)
    if most is not None:
        out = out.where(F.col("confidence") <= most)
    if text is not None:
        out = out.where(F.contains(F.lower("statement"), F.lit(text.lower())))
    return out.orderBy(F.desc("confidence"), F.desc("candidate_id")).limit(k)


def semantic_lane(candidate: DataFrame, known: DataFrame, duplicate: float = 0.97, similar: float = 0.83) -> DataFrame:
    """(candidate_id, lane): duplicate, similar or kept, by cosine with the subject's live facts and
    with its candidates kept so far, in order of confidence.

    `candidate` is (candidate_id, subject, confidence, embedding), `known` (subject, embedding).
    What is kept decides what comes later, so the fold is sequential within a subject.
    """

    def fold(key, left, right):
        import numpy as np
        import pandas as pd

        def unit(x):
            x = np.asarray(x, float)
            n = np.linalg.norm(x)
            return x / n if n else x

        kept = [unit(x) for x in right["embedding"]]
        lanes = []
        for row in left.sort_values(["confidence", "candidate_id"], ascending=[False, False]).itertuples():
            v = unit(row.embedding)
            best = max((float(v @ k) for k in kept), default=0.0)
            lane = "duplicate" if best >= duplicate else "similar" if best >= similar else "kept"
            if lane != "duplicate":
                kept.append(v)
            lanes.append((row.candidate_id, lane))
        return pd.DataFrame(lanes, columns=["candidate_id", "lane"])

    return candidate.groupBy("subject").cogroup(known.groupBy("subject")).applyInPandas(fold, "candidate_id bigint, lane string")


def corrections(episode: DataFrame) -> DataFrame:
    """(episode_id, fact_uid, wrong, right, about) of the corrections in the episodes' meta JSON."""
    schema = "struct<corrections: array<struct<fact_uid: string, wrong: string, right: string, about: string>>>"
    return episode.select("episode_id", F.explode(F.from_json("meta", schema)["corrections"]).alias("c")).select("episode_id", "c.fact_uid", "c.wrong", "c.right", "c.about")


def task_board(task: DataFrame, k: int | None = None) -> DataFrame:
    """Open tasks: next, waiting, scheduled, inbox, someday; by due date, those without last."""
    order = F.when(F.col("status") == "next", 0).when(F.col("status") == "waiting", 1).when(F.col("status") == "scheduled", 2).when(F.col("status") == "inbox", 3).otherwise(4)
    out = task.where("status <> 'done'").orderBy(order, F.col("due_at").asc_nulls_last(), "created")
    return out.limit(k) if k else out


def overdue(task: DataFrame, as_of: Column) -> DataFrame:
    return task.where((F.col("status") != "done") & (F.col("due_at") < as_of.cast("date")))


def stalled_projects(projects: DataFrame, mention: DataFrame, episode: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Projects that no episode of the last days mentions."""
    recent = mention.join(episode.where((F.col("occurred_at") >= as_of - F.expr(f"INTERVAL {days} DAY")) & (F.col("occurred_at") <= as_of)).select("episode_id"), "episode_id", "left_semi")
    return projects.join(recent.select("node_id").distinct(), "node_id", "left_anti")


def memory_digest(fact: DataFrame, k: int = 20, budget: int | None = None) -> DataFrame:
    """The most salient live positive facts that may be shown, those within a token budget where there is one."""
    live = fact.where(fn.is_live() & (F.col("polarity") == "positive") & F.col("sensitivity").isin(*fn.SHOWN))
    salience = F.col("confidence") * (1 + 0.1 * F.least("observations", F.lit(10)))
    order = [F.desc(F.round("salience", 9)), F.col("fact_id")]
    top = live.withColumn("salience", salience).orderBy(*order).limit(k).select("fact_id", "statement", "salience")
    if budget is None:
        return top
    spent = F.sum(fn.estimate_tokens(F.col("statement"))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # at most k rows
    return top.withColumn("_spent", spent).where(F.col("_spent") <= budget).drop("_spent")
