"""The triage of proposed claims: lanes in a fixed order, each candidate settled by the first that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from .aggregates import SINGLE_VALUED
from .facts import assert_facts, close

#: That something was talked about is what its episode says already.
EPHEMERAL = ("discussed", "discussed_with", "discusses", "discussing", "mentioned", "mentions", "said", "shared", "spoke_about", "talked_about", "talked_to")
#: Predicates that state a property, under which a sentence about a past moment is misplaced.
PROPERTY = ("demonstrated", "has", "has_role", "is")
EVENTIVE = (" was ", " were ", "that day", "yesterday", "this morning", "last night", "last week")
#: Claims about a person's standing with others are never accepted by a machine.
NEVER_AUTO = ("colleague_of", "family_of", "friend_of", "mentors")
#: (proposer, predicate) of relations that a verified candidate may enter without a reviewer.
DURABLE = tuple(("llm", p) for p in ("authored", "collaborates_with", "contains", "discussed_during", "located_in", "member_of", "related_to", "uses", "works_at", "works_on"))
LANES = ("commitment", "rejected_before", "ephemeral", "eventive", "known", "queued_twice", "unresolved", "contradiction", "accept", "review")
#: Lanes that reject; the reason begins with this, so that it isn't taken for a reviewer's.
REJECTING = ("rejected_before", "ephemeral", "eventive", "known", "queued_twice")
BY_MACHINE = "precheck:"


def eventive(predicate: Column, statement: Column) -> Column:
    """A property predicate over a sentence about a past moment."""
    said = F.concat(F.lit(" "), F.lower(statement), F.lit(" "))
    return predicate.isin(*PROPERTY) & reduce(lambda a, b: a | b, [F.contains(said, F.lit(m)) for m in EVENTIVE])


def by_reviewer(candidate: DataFrame) -> Column:
    """Whether a decision was a person's: one without a reason is."""
    return ~F.coalesce(F.col("reject_reason"), F.lit("")).startswith(BY_MACHINE) if "reject_reason" in candidate.columns else F.lit(True)


def precheck(candidate: DataFrame, fact: DataFrame, resolved: DataFrame, rungs: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """(candidate_id, lane, fact_id) of pending candidates; fact_id is the live fact that is already known.

    `candidate` has predicate (canonical), subject, object_id, statement, confidence, status, kind and
    where it was rejected reject_reason; `resolved` is (subject, node_id) of subjects that mean one
    node, `rungs` (proposer, predicate, rung), `supported` (candidate_id) those that a verifier found
    supported.  Facts are those before the pass: what it accepts doesn't change it.

    Only a reviewer's rejections are remembered: a twin that the pass itself rejects has the same
    words as the one that stays.  Twins are of one node, or where that isn't known of one subject,
    and have the same words or the same triple.  A sampled class holds back every tenth for review.
    """
    said = fn.normalize(F.col("statement"))
    c = candidate.where("status = 'proposed'").withColumns({"said": said, "subject_key": fn.canonicalize(F.col("subject"))})
    c = c.join(resolved.select(fn.canonicalize(F.col("subject")).alias("subject_key"), "node_id").dropDuplicates(["subject_key"]), "subject_key", "left")
    refused = candidate.where((F.col("status") == "rejected") & by_reviewer(candidate)).select(said.alias("said"), F.lit(True).alias("refused")).where("said <> ''").distinct()
    live = fact.where(fn.is_live() & (F.col("polarity") == "positive"))
    by_triple = live.groupBy(F.col("subject_id").alias("node_id"), "predicate", "object_id").agg(F.min("fact_id").alias("same_triple"))
    by_words = live.groupBy(F.col("subject_id").alias("node_id"), said.alias("said")).agg(F.min("fact_id").alias("same_words")).where("said <> ''")
    other = live.where(F.col("predicate").isin(*SINGLE_VALUED)).groupBy(F.col("subject_id").alias("node_id"), "predicate").agg(F.collect_set("object_id").alias("objects"))
    c = c.join(refused, "said", "left").join(by_triple, ["node_id", "predicate", "object_id"], "left").join(by_words, ["node_id", "said"], "left").join(other, ["node_id", "predicate"], "left")
    c = c.join(rungs.select("proposer", "predicate", "rung"), ["proposer", "predicate"], "left")
    c = c.join(supported.select("candidate_id").distinct().withColumn("vetted", F.lit(True)), "candidate_id", "left") if supported is not None else c.withColumn("vetted", F.lit(None).cast("boolean"))
    fact_id = F.coalesce("same_triple", "same_words")
    early = (
        F.when(F.col("kind") == "commitment", "commitment")
        .when(F.col("refused"), "rejected_before")
        .when(F.col("predicate").isin(*EPHEMERAL), "ephemeral")
        .when(eventive(F.col("predicate"), F.col("statement")), "eventive")
        .when(fact_id.isNotNull(), "known")
    )
    owner = F.coalesce("node_id", F.concat(F.lit("~"), "subject_key"))
    c = c.withColumns({"early": early, "owner": owner})
    order = [F.desc("confidence"), F.desc("candidate_id")]
    same_words = F.row_number().over(Window.partitionBy(F.isnull("early"), "owner", "said").orderBy(*order))
    same_triple = F.row_number().over(Window.partitionBy(F.isnull("early"), "owner", "predicate", "object_id").orderBy(*order))
    twice = ((same_words > 1) & (F.col("said") != "")) | ((same_triple > 1) & F.col("object_id").isNotNull() & F.col("node_id").isNotNull())
    known_other = (F.size("objects") > 0) & ~F.coalesce(F.forall("objects", lambda o: o == F.col("object_id")), F.lit(False))
    durable = reduce(lambda a, b: a | b, [(F.col("proposer") == x) & (F.col("predicate") == y) for x, y in DURABLE])
    free = (F.col("rung") == "trusted") | ((F.col("rung") == "sampled") & (F.col("candidate_id") % 10 != 0)) | (durable & F.col("vetted"))
    lane = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("twice"), "queued_twice")
        .when(F.col("node_id").isNull(), "unresolved")
        .when(known_other, "contradiction")
        .when(free & ~F.col("predicate").isin(*NEVER_AUTO), "accept")
        .otherwise("review")
    )
    return c.withColumn("twice", twice).select("candidate_id", lane.alias("lane"), F.when(lane == "known", fact_id).alias("fact_id"))


def settle(candidate: DataFrame, lanes: DataFrame) -> DataFrame:
    """`candidate` with the statuses and reasons that the lanes give; the others stay for review."""
    gone = F.col("lane").isin(*REJECTING)
    status = F.when(gone, "rejected").when(F.col("lane") == "accept", "accepted").otherwise(F.col("status"))
    out = candidate if "reject_reason" in candidate.columns else candidate.withColumn("reject_reason", F.lit(None).cast("string"))
    reason = F.when(gone, F.concat(F.lit(f"{BY_MACHINE} "), "lane")).otherwise(F.col("reject_reason"))
    return out.join(lanes.select("candidate_id", "lane"), "candidate_id", "left").withColumns({"status": status, "reject_reason": reason}).drop("lane")


def reject(candidate: DataFrame, ids: DataFrame, reason: str | None = None) -> DataFrame:
    """`candidate` with the pending ones of `ids` (candidate_id) rejected by a reviewer."""
    hit = F.col("_hit") & (F.col("status") == "proposed")
    both = candidate.join(ids.select("candidate_id", F.lit(True).alias("_hit")).distinct(), "candidate_id", "left")
    return both.withColumns({"reject_reason": F.when(hit, F.lit(reason)).otherwise(F.col("reject_reason")), "status": F.when(hit, "rejected").otherwise(F.col("status"))}).drop("_hit").select(*candidate.columns)


def bumped(fact: DataFrame, lanes: DataFrame) -> DataFrame:
    """`fact` with an observation more for each candidate that was known already."""
    n = lanes.where("lane = 'known'").groupBy("fact_id").agg(F.count("*").alias("_n"))
    return fact.join(n, "fact_id", "left").withColumn("observations", (F.col("observations") + F.coalesce("_n", F.lit(0))).cast("int")).select(*fact.columns)


def propose(candidate: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """`candidate` with `incoming` (proposer, predicate, subject, statement, confidence, ...) pending.

    Missing columns are null; the identifier is a hash of the claim, its proposer and its episode, so
    that proposing twice changes nothing.
    """
    have = set(incoming.columns)
    columns = {c: F.col(c) if c in have else F.lit(None) for c in candidate.columns}
    claim = [F.coalesce(columns.get(c, F.lit(None)).cast("string"), F.lit("")) for c in ("proposer", "predicate", "subject", "object_id", "object_value", "statement", "episode_id")]
    made = {"candidate_id": F.xxhash64(*claim), "status": F.lit("proposed"), "kind": F.coalesce(columns.get("kind", F.lit(None)), F.lit("fact")), "created_at": at}
    rows = incoming.select(*[made.get(c, columns[c]).cast(candidate.schema[c].dataType).alias(c) for c in candidate.columns]).dropDuplicates(["candidate_id"])
    return candidate.unionByName(rows.join(candidate.select("candidate_id"), "candidate_id", "left_anti").select(*candidate.columns))


def update_payload(candidate: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """`candidate` with `key` of the payload of those in `change` (candidate_id, value) set."""
    both = candidate.join(change.select("candidate_id", F.col("value").alias("_value")), "candidate_id", "left")
    return both.withColumn("payload", F.when(F.col("_value").isNotNull(), fn.json_set(F.col("payload"), key, F.col("_value"))).otherwise(F.col("payload"))).select(*candidate.columns)


def pending_about(candidate: DataFrame, resolved: DataFrame, node_id: str) -> DataFrame:
    """Pending candidates whose subject means the node or whose object it is, the surest first."""
    names = resolved.where(F.col("node_id") == node_id).select(fn.canonicalize(F.col("subject")).alias("_key")).distinct()
    own = candidate.where("status = 'proposed'").join(names.withColumn("_hit", F.lit(True)), fn.canonicalize(F.col("subject")) == F.col("_key"), "left")
    return own.where(F.col("_hit") | (F.col("object_id") == node_id)).orderBy(F.desc("confidence"), F.desc("candidate_id")).select(*candidate.columns)


def pending_in_class(candidate: DataFrame, proposer: str, predicate: str, k: int) -> DataFrame:
    """The oldest k pending candidates of a class."""
    own = candidate.where((F.col("status") == "proposed") & (F.col("proposer") == proposer) & (F.col("predicate") == predicate))
    return own.orderBy(*(["created_at"] if "created_at" in candidate.columns else []), "candidate_id").limit(k)


def headed(candidate: DataFrame, detected: DataFrame, owner_name: str | None = None) -> DataFrame:
    """Pending candidates without a subject get one, and `marker` says how.

    `detected` is (candidate_id, name, node_type) of entities in the statement: a person, else the least
    name; else the statement's own noun phrase; else, for facts that a wearable suggests, its owner.
    """
    first = detected.groupBy("candidate_id").agg(F.min(F.struct((F.col("node_type") != "person").alias("_p"), F.col("name"))).alias("_d"))
    both = candidate.join(first, "candidate_id", "left")
    bare = (F.col("status") == "proposed") & (F.coalesce(F.trim("subject"), F.lit("")) == "")
    phrase = fn.subject_phrase(F.col("statement"))
    implied = F.when(F.col("proposer") == "bee:suggested", F.lit(owner_name))
    marker = F.when(bare, F.when(F.col("_d.name").isNotNull(), "subject_backfilled").when(phrase.isNotNull(), "subject_phrase").when(implied.isNotNull(), "subject_implied"))
    subject = F.when(bare, F.coalesce(F.col("_d.name"), phrase, implied, "subject")).otherwise(F.col("subject"))
    return both.select(*[subject.alias("subject") if c == "subject" else F.col(c) for c in candidate.columns], marker.alias("marker"))


def accepted_claims(candidate: DataFrame, lanes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims for `facts.assert_facts` of the candidates that are accepted.

    An object that isn't a node is a name: of one node (`resolved` as for subjects) or else a literal.
    """
    ok = candidate.join(lanes.where("lane = 'accept'").select("candidate_id"), "candidate_id", "left_semi").withColumn("subject_key", fn.canonicalize(F.col("subject")))
    key = resolved.select(fn.canonicalize(F.col("subject")).alias("subject_key"), F.col("node_id").alias("subject_id")).dropDuplicates(["subject_key"])
    both = ok.join(key, "subject_key")
    value = F.col("object_value") if "object_value" in candidate.columns else F.lit(None).cast("string")
    both = both.withColumn("_value", value).join(key.select(F.col("subject_key").alias("_name"), F.col("subject_id").alias("_object")), fn.canonicalize(F.col("_value")) == F.col("_name"), "left")
    object_id = F.coalesce("object_id", "_object")
    return both.select(
        "subject_id", "predicate", object_id.alias("object_id"), F.when(object_id.isNull(), F.col("_value")).alias("object_value"), F.lit("positive").alias("polarity"), "statement", "episode_id", "confidence",
        F.lit("personal").alias("sensitivity"), F.col("proposer").alias("extractor"), F.col("created_at").alias("at"),
    )


def record_verdicts(verdict: DataFrame, incoming: DataFrame) -> DataFrame:
    """`verdict` with `incoming` (candidate_id, mechanism, verdict, basis) open; one of a mechanism replaces its last open one."""
    key = ["candidate_id", "mechanism"]
    new = incoming.groupBy(*key).agg(F.max(F.struct("verdict", "basis")).alias("v")).select(*key, "v.verdict", "v.basis", F.lit(None).cast("string").alias("outcome"))
    kept = verdict.join(new.select(*key, F.lit(True).alias("_again")), key, "left").where(~(F.coalesce("_again", F.lit(False)) & F.col("outcome").isNull()))
    return kept.select(*verdict.columns).unionByName(new.select(*verdict.columns))


def score_verdicts(verdict: DataFrame, candidate: DataFrame) -> DataFrame:
    """Open verdicts whose candidate was reviewed get the outcome right or wrong."""
    done = candidate.where("status <> 'proposed'").select("candidate_id", F.col("status").alias("_status"))
    agrees = ((F.col("verdict") == "accept") & (F.col("_status") == "accepted")) | ((F.col("verdict") == "reject") & (F.col("_status") == "rejected"))
    outcome = F.when(F.col("outcome").isNull() & F.col("_status").isNotNull(), F.when(agrees, "right").otherwise("wrong")).otherwise(F.col("outcome"))
    return verdict.join(done, "candidate_id", "left").withColumn("outcome", outcome).drop("_status")


def correction_targets(correction: DataFrame, fact: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """`correction` with fact_id and target, live, closed or unresolved, for `facts.corrections`.

    By identifier, else by the one live fact of the same statement, case aside; of several only where
    `about` (about, node_id), names that mean one node, leaves one.  Where only closed facts say so the
    correction was made before.  All by equality.
    """
    c = correction.withColumn("_wrong", F.lower(F.trim("wrong")))
    if about is not None:
        c = c.join(about.select(fn.canonicalize(F.col("about")).alias("_about"), F.col("node_id").alias("_node")).dropDuplicates(["_about"]), fn.canonicalize(F.col("about")) == F.col("_about"), "left").drop("_about")
    else:
        c = c.withColumn("_node", F.lit(None).cast("string"))
    f = fact.select("fact_id", "subject_id", F.lower(F.trim("statement")).alias("_said"), fn.is_live().alias("_live"))
    key = ["episode_id", "fact_uid", "wrong", "right", "about"]
    by_id = c.where("fact_uid IS NOT NULL").join(f, F.col("fact_uid") == F.col("fact_id"), "left")
    by_id = by_id.select(*key, F.when(F.col("_live"), F.col("fact_id")).alias("fact_id"), F.when(F.col("_live"), "live").when(F.col("fact_id").isNotNull(), "closed").otherwise("unresolved").alias("target"))
    said = (F.col("_wrong") == F.col("_said")) & (F.col("_node").isNull() | (F.col("_node") == F.col("subject_id")))
    loose = c.where("fact_uid IS NULL").join(f, said, "left").groupBy(*key).agg(F.min(F.when(F.col("_live"), F.col("fact_id"))).alias("_one"), F.count_if("_live").alias("_n"), F.count_if(~F.col("_live")).alias("_closed"))
    one = F.col("_n") == 1
    loose = loose.select(*key, F.when(one, F.col("_one")).alias("fact_id"), F.when(one, "live").when((F.col("_n") == 0) & (F.col("_closed") > 0), "closed").otherwise("unresolved").alias("target"))
    return by_id.union(loose)


def apply_corrections(targets: DataFrame, fact: DataFrame, at: Column, sweep: int = 25) -> dict[str, DataFrame]:
    """What the corrections of :func:`correction_targets` change.

    ``fact``: the table with the corrected facts superseded, and where nothing is put in their place
    their negation; ``observation``: a corrected one for each; ``candidate``: the replacement, or the
    unresolved correction, for a reviewer; ``demotion``: the classes that produced the facts;
    ``sweep``: at most `sweep` other live facts of each such class, to be asked about.
    """
    pinned = targets.where("target = 'live'").select("fact_id", F.col("episode_id").alias("said_in"), F.nullif(F.trim("right"), F.lit("")).alias("right"))
    live = pinned.join(fact.drop("episode_id"), "fact_id")
    ended = close(fact, live, "supersede", at)
    denied = live.where("right IS NULL").select(
        "subject_id", "predicate", "object_id", "object_value", F.lit("negative").alias("polarity"), F.concat(F.lit("It is not the case that: "), "statement").alias("statement"), F.col("said_in").alias("episode_id"),
        F.lit(0.95).alias("confidence"), "sensitivity", F.lit("correction").alias("extractor"), at.alias("at"),
    )
    observation = live.select("fact_id", F.lit("corrected").alias("kind"), F.lit("user").alias("method"), F.col("said_in").alias("episode_id"), at.alias("observed_at"))
    staged = live.where("right IS NOT NULL").select(F.lit("correction").alias("proposer"), "predicate", F.col("subject_id").alias("subject"), F.col("right").alias("statement"), F.lit(0.95).alias("confidence"), F.col("said_in").alias("episode_id"))
    unknown = targets.where("target = 'unresolved'")
    words = F.concat(F.lit("UNRESOLVED CORRECTION: wrong: "), F.coalesce("wrong", "fact_uid", F.lit("?")), F.lit(" | right: "), F.coalesce("right", F.lit("(rejection)")), F.lit(" | about: "), F.coalesce("about", F.lit("?")))
    asked = unknown.select(F.lit("correction").alias("proposer"), F.lit("correction").alias("predicate"), F.coalesce("about", F.lit("")).alias("subject"), words.alias("statement"), F.lit(0.95).alias("confidence"), "episode_id")
    demotion = live.where("extractor IS NOT NULL AND extractor <> ''").select(F.col("extractor").alias("proposer"), "predicate").distinct()
    peers = fact.where(fn.is_live() & (F.col("polarity") == "positive")).join(live.select("fact_id"), "fact_id", "left_anti").join(demotion.withColumnRenamed("proposer", "extractor"), ["extractor", "predicate"], "left_semi")
    swept = peers.withColumn("_r", F.row_number().over(Window.partitionBy("extractor", "predicate").orderBy("fact_id"))).where(F.col("_r") <= sweep).select(F.col("extractor").alias("proposer"), "predicate", "fact_id")
    return {"fact": assert_facts(ended, denied), "observation": observation, "candidate": staged.union(asked), "demotion": demotion, "sweep": swept}
