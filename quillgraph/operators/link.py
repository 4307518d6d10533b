"""Deriving relationships: name scans, co-occurrence, interval overlap, centroid similarity,
structural link prediction, closure rules and bounded traversal.

Every derived table is a lazy DataFrame.  Pairs are canonical (a < b), caps are applied with a
total order, and floors such as "at least ten episodes" are columns of a one-row table rather than
actions, so that a plan never stops to look at its data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..session import parts, written
from .aggregates import centroids

NPMI_TYPES = ("org", "person", "place", "project", "topic")
KNN_TYPES = ("org", "place", "project", "topic")


def with_words(df: DataFrame, text: str) -> DataFrame:
    """`df` with its text's words as the column `words`.

    A lambda would evaluate the expression again for each element; a generator is a barrier
    that computes it once a row.
    """
    return df.select("*", F.explode(F.array(F.split(fn.normalize(F.col(text)), " "))).alias("words"))


def word_grams(words: Column, longest: int) -> Column:
    """The distinct runs of 1 to `longest` words."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    grams = [words, *(of_length(n) for n in range(2, longest + 1))]
    return F.array_distinct(F.flatten(F.array(*grams)))


def name_hits(texts: DataFrame, key: str, names: DataFrame, longest: int) -> DataFrame:
    """(key, gram, node_id): names (gram, node_id), of any number of words, that occur in `texts` (key, words).

    A name of more than `longest` words is found by its first ones and then compared as a whole.
    """
    runs = texts.select(key, F.explode(word_grams(F.col("words"), longest)).alias("gram"))
    parts = F.split("gram", " ")
    longer = names.where(F.size(parts) > longest).select(F.array_join(F.slice(parts, 1, longest), " ").alias("anchor"), F.col("gram").alias("name"), "node_id")
    if longer.isEmpty():  # else all texts are shuffled to be compared with none
        return runs.join(names, "gram").select(key, "gram", "node_id")
    maybe = runs.join(longer, F.col("gram") == F.col("anchor")).select(F.col(key).alias("_key"), "name", "node_id")
    padded = [F.concat(F.lit(" "), x, F.lit(" ")) for x in (F.array_join("words", " "), F.col("name"))]
    found = texts.join(maybe, F.col(key).eqNullSafe(F.col("_key"))).where(F.contains(*padded)).select(key, F.col("name").alias("gram"), "node_id")
    return runs.join(names, "gram").select(key, "gram", "node_id").union(found)


def alias_scan(episode: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(episode_id, node_id): episodes in which a unique name occurs as whole words.

    The texts are cut into word runs and joined on equality, which shuffles on the name instead of
    comparing each text with each name.  `names` is (name, node_id); see :func:`name_hits` for those
    of more than `longest` words.
    """
    wanted = names.select(fn.normalize(F.col("name")).alias("gram"), "node_id").where(F.char_length("gram") >= 3)
    return name_hits(with_words(episode.select("episode_id", "body"), "body"), "episode_id", wanted, longest).select("episode_id", "node_id").distinct()


def relink(mention: DataFrame, found: DataFrame) -> DataFrame:
    """All mentions with the alias ones made anew: the most confident wins, the first extractor stays."""
    kept = mention.where("extractor <> 'alias'").select("episode_id", "node_id", "extractor", "confidence", F.lit(0).alias("seq"))
    fresh = found.select("episode_id", "node_id", F.lit("alias").alias("extractor"), F.lit(0.8).alias("confidence"), F.lit(1).alias("seq"))
    return merge_mentions(kept.union(fresh))


def merge_mentions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("episode_id", "node_id").agg(F.min_by("extractor", "seq").alias("extractor"), F.max("confidence").alias("confidence"))


#: So many chosen pairs can be broadcast, with their nodes: some MB.
FEW = 100_000


def are_few(only: DataFrame) -> bool:
    return only.limit(FEW + 1).count() <= FEW


def _placed(mention: DataFrame, n: int, only: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Distinct (episode_id, node_id), each episode in one of `n` partitions; with `only` (a, b) of these pairs' nodes.

    The nodes lie in `n` partitions too and are hashed there, so that mentions stream past them and those of one
    node aren't sorted in a task.  A `few` are broadcast instead, so that other nodes' mentions aren't shuffled at all.
    """
    m = mention.select("episode_id", "node_id")
    if only is not None:
        nodes = only.select(F.explode(F.array("a", "b")).alias("node_id"))
        nodes = F.broadcast(nodes.distinct()) if few else nodes.repartition(n, "node_id").hint("shuffle_hash")
        m = m.join(nodes, "node_id", "left_semi").select("episode_id", "node_id")
    return m.repartition(n, "episode_id").distinct()


def _shared(m: DataFrame) -> DataFrame:
    """(episode_id, a, b): the pairs of nodes in each episode of :func:`_placed`."""
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.episode_id") == F.col("y.episode_id")) & (F.col("x.node_id") < F.col("y.node_id")))
    return pairs.select("x.episode_id", F.col("x.node_id").alias("a"), F.col("y.node_id").alias("b"))


def _chosen(pairs: DataFrame, n: int, only: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Rows of (a, b), each pair in one of `n` partitions; with `only` of these pairs, which are hashed there.

    Of a `few` pairs the rows stay where they are, as counting these first takes little memory.
    """
    if few:
        return pairs.join(F.broadcast(only.select("a", "b").distinct()), ["a", "b"], "left_semi")
    placed = pairs.repartition(n, "a", "b")
    return placed if only is None else placed.join(only.select("a", "b").repartition(n, "a", "b").hint("shuffle_hash"), ["a", "b"], "left_semi")


def shared_counts(mention: DataFrame, least: int, only: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(a, b, co) of nodes that share `least` episodes at least; with `only` (a, b) of these pairs.

    Episodes and then pairs lie in as many partitions as the mentions' size asks for: pairs don't repeat within
    an episode, so that counting them before they are shuffled would fill a task's memory for little.  Of chosen
    pairs only mentions of their nodes are paired, and a `few` (see :func:`are_few`) are broadcast.
    """
    n = parts(mention)
    pairs = _shared(_placed(mention, n, only, few)).select("a", "b")
    return _chosen(pairs, n, only, few).groupBy("a", "b").agg(F.count("*").alias("co")).where(F.col("co") >= least)


def pair_counts(mention: DataFrame, least: int = 3, only: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(a, b, co, n_a, n_b, universe) of nodes that share `least` episodes at least; see :func:`shared_counts`.

    The self-join is on the episode, so its size is the sum of squares of nodes an episode has,
    not of episodes a node has; counts are taken before the marginals are joined.  The universe has all episodes,
    and the marginals of a `few` pairs only their nodes.
    """
    m = ids = mention.select("episode_id", "node_id").distinct()
    if few:
        m, ids = _placed(mention, parts(mention), only, few), mention.select("episode_id")
        ids = ids.repartition(parts(ids, 4), "episode_id")  # made distinct in the default number of partitions they fill a task's memory
    co = shared_counts(mention, least, only, few)
    marginal = m.groupBy("node_id").agg(F.count("*").alias("n"))
    co = co.join(marginal.select(F.col("node_id").alias("a"), F.col("n").alias("n_a")), "a").join(marginal.select(F.col("node_id").alias("b"), F.col("n").alias("n_b")), "b")
    return co.crossJoin(F.broadcast(ids.agg(F.countDistinct("episode_id").alias("universe"))))  # one row


def npmi(co: Column, n_a: Column, n_b: Column, universe: Column) -> Column:
    """Normalised pointwise mutual information; null where every episode has both."""
    co, n_a, n_b, universe = (c.cast("double") for c in (co, n_a, n_b, universe))
    return F.when(co < universe, F.log(co * universe / (n_a * n_b)) / -F.log(co / universe))


def link_npmi(mention: DataFrame, connected: DataFrame, least_co: int = 3, threshold: float = 0.3, floor: int = 10, cap: float = 0.85) -> DataFrame:
    """(a, b, co, npmi, confidence) of associated pairs that `connected` (a, b) doesn't have."""
    scored = pair_counts(mention, least_co).where(F.col("universe") >= floor)
    scored = scored.withColumn("npmi", npmi(F.col("co"), F.col("n_a"), F.col("n_b"), F.col("universe"))).where(F.col("npmi") >= threshold)
    fresh = scored.join(canonical(connected), ["a", "b"], "left_anti")
    return fresh.select("a", "b", "co", "npmi", F.least("npmi", F.lit(cap)).alias("confidence"))


def canonical(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def live_pairs(fact: DataFrame) -> DataFrame:
    live = fact.where(fn.is_live() & (F.col("polarity") == "positive") & F.col("object_id").isNotNull())
    return canonical(live.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))


def shared_episodes(mention: DataFrame, a: str, b: str) -> DataFrame:
    one, two = (mention.where(F.col("node_id") == n).select("episode_id") for n in (a, b))
    return one.distinct().join(two, "episode_id", "left_semi")


def interval_overlaps(left: DataFrame, right: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """Pairs of (id, start, end) rows whose half-open intervals overlap, with the coverage of the left one.

    Each interval is posted in the time bins that it touches, to the microsecond, and the join is an
    equality on the bin.  A pair is kept in the first bin that both touch, so it needs no distinct.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        micros = [F.unix_micros(F.col("start").cast("timestamp")), F.unix_micros(F.col("end").cast("timestamp")) - 1]
        width = F.lit(bin_seconds * 1_000_000)
        first, last = (((m - F.pmod(m, width)) / width).cast("bigint") for m in micros)
        return df.where("end > start").select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "start", "end")], first.alias(f"{side}_bin"), F.explode(F.sequence(first, last)).alias("bin"))

    both = binned(left, "l").join(binned(right, "r"), "bin")
    both = both.where((F.col("r_start") < F.col("l_end")) & (F.col("r_end") > F.col("l_start")) & (F.col("bin") == F.greatest("l_bin", "r_bin")))
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("l_start", "l_end", "r_start", "r_end")}
    common = F.least(micros["l_end"], micros["r_end"]) - F.greatest(micros["l_start"], micros["r_start"])
    cover = F.greatest(F.lit(0.0), F.least(F.lit(1.0), common / (micros["l_end"] - micros["l_start"])))
    return both.select("l_id", "r_id", cover.alias("coverage"))


#: Extractors of the people that an event was sent to.
INVITED = ("attendee", "deterministic")


def link_temporal(episode: DataFrame, mention: DataFrame, nodes: DataFrame, least: float = 0.25) -> DataFrame:
    """(episode_id, node_id, extractor, confidence): recordings linked to the people of an event that they cover.

    Those invited get 0.35 and more; those that only the event's text names, and who weren't invited to
    it, 0.20 and more, always less: a name in a title says that it was about someone, not with them.
    """
    span = [F.col("episode_id").alias("id"), F.col("occurred_at").alias("start"), F.col("occurred_end").alias("end")]
    events = episode.where("source = 'calendar.event' AND occurred_end IS NOT NULL").select(*span)
    talks = episode.where("source = 'bee.conversation' AND occurred_end IS NOT NULL").select(*span)
    pairs = interval_overlaps(events, talks).where(F.col("coverage") >= least)
    people = mention.where(F.col("extractor").isin(*INVITED, "alias")).join(nodes.where("node_type = 'person'").select("node_id"), "node_id", "left_semi")
    people = people.groupBy(F.col("episode_id").alias("l_id"), "node_id").agg(F.max(F.col("extractor") != "alias").alias("invited"))
    linked = pairs.join(people, "l_id").groupBy(F.col("r_id").alias("episode_id"), "node_id").agg(F.max(F.struct("invited", "coverage")).alias("best"))
    invited, w = F.col("best.invited"), F.col("best.coverage")
    return linked.select("episode_id", "node_id", F.when(invited, "temporal_join").otherwise("temporal_title").alias("extractor"), F.when(invited, 0.35 + 0.4 * w).otherwise(0.20 + 0.25 * w).alias("confidence"))


def temporal_report(episode: DataFrame, least: float = 0.25) -> DataFrame:
    """One row: events, recordings, overlapping pairs, and pairs covered enough."""
    span = [F.col("episode_id").alias("id"), F.col("occurred_at").alias("start"), F.col("occurred_end").alias("end")]
    events = episode.where("source = 'calendar.event' AND occurred_end IS NOT NULL").select(*span)
    talks = episode.where("source = 'bee.conversation' AND occurred_end IS NOT NULL").select(*span)
    pairs = interval_overlaps(events, talks).agg(F.count("*").alias("overlaps"), F.count_if(F.col("coverage") >= least).alias("linked"))
    return events.agg(F.count("*").alias("events")).crossJoin(F.broadcast(talks.agg(F.count("*").alias("recordings")))).crossJoin(F.broadcast(pairs))  # single rows


def link_knn(vector: DataFrame, nodes: DataFrame, connected: DataFrame, least_mentions: int = 3, threshold: float = 0.15, cap: int = 40) -> DataFrame:
    """(a, b, similarity, confidence): nodes of one type whose centred centroids point alike.

    The cap comes before the check for known pairs, so fewer may be left.
    """
    means = centroids(vector, least_mentions).join(nodes.where(F.col("node_type").isin(*KNN_TYPES)).select("node_id", "node_type"), "node_id")
    parts = means.select("node_id", "node_type", F.posexplode("centroid").alias("pos", "x"))
    overall = parts.groupBy("pos").agg(F.avg("x").alias("mean"))  # one row a dimension
    centred = parts.join(F.broadcast(overall), "pos").groupBy("node_id", "node_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("x") - F.col("mean")).alias("x")))), lambda s: s["x"]).alias("v"))
    a, b = centred.alias("a"), centred.alias("b")
    pairs = a.join(b, (F.col("a.node_type") == F.col("b.node_type")) & (F.col("a.node_id") < F.col("b.node_id")))
    scored = pairs.select(F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"), fn.cosine(F.col("a.v"), F.col("b.v")).alias("similarity"))
    top = scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "a", "b").limit(cap)
    confidence = F.greatest(F.lit(0.4), F.least(F.lit(0.7), 0.4 + (F.col("similarity") - threshold) * 1.5))
    return top.join(canonical(connected), ["a", "b"], "left_anti").select("a", "b", "similarity", confidence.alias("confidence"))


def _arms(edges: DataFrame) -> DataFrame:
    """(z, u, aa, ra, deg): each node u beside a neighbour z of at least two, and what z is worth to a pair."""
    one = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("deg")).where("deg >= 2").select(F.col("a").alias("z"), "deg")
    deg = F.col("deg").cast("double")
    worth = degree.select("z", (1.0 / F.greatest(F.log(deg), F.lit(0.1))).alias("aa"), (1.0 / deg).alias("ra"), "deg")
    return both.select(F.col("a").alias("z"), F.col("b").alias("u")).join(worth, "z")


def _wedges(arm: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b, aa, ra) of each neighbour that a row of `arm` and one of `other` share."""
    return arm.join(other.select("z", F.col("u").alias("w")), "z").where("u < w").select(F.col("u").alias("a"), F.col("w").alias("b"), "aa", "ra")


def _summed(wedge: DataFrame) -> DataFrame:
    return wedge.groupBy("a", "b").agg(F.sum("aa").alias("aa"), F.sum("ra").alias("ra"))


def neighbour_scores(edges: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, aa, ra): Adamic-Adar and resource allocation over the common neighbours of each wedge.

    With `queries` (node_id) each of these against all nodes: (query_id, id, aa, ra).  Wedges grow with the
    square of a hub's degree, and so do the pairs, which are the result.  The queries' edges are broadcast, so
    that all wedges of a node meet where it is and pairs aren't shuffled.
    """
    arm = _arms(edges).drop("deg")
    if queries is None:
        return _summed(_wedges(arm, arm))
    asked = arm.join(queries.select(F.col("node_id").alias("u")).distinct(), "u", "left_semi").select("z", F.col("u").alias("query_id"))
    placed = arm.repartition(parts(edges, 0.02), "u")
    return placed.join(F.broadcast(asked), "z").where("query_id <> u").groupBy("query_id", F.col("u").alias("id")).agg(F.sum("aa").alias("aa"), F.sum("ra").alias("ra"))


def strong_scores(edges: DataFrame, least_aa: float, least_ra: float, light: int = 64) -> DataFrame:
    """The pairs of :func:`neighbour_scores` that reach either floor, without the wedges of hubs that can't.

    A neighbour of at most `light` others is light; wedges over these grow with the edges.  What a node
    has of heavy ones bounds what these give to its pairs, so they are looked up only for pairs that lack no more than
    that to a floor: those with a light neighbour in common, or both of whose nodes reach a floor by heavy ones alone.
    """
    arm = _arms(edges)
    heavy = arm.where(F.col("deg") > light).drop("deg")
    near = _summed(_wedges(*[arm.where(F.col("deg") <= light).drop("deg")] * 2))
    slack = 1e-9  # sums round
    bound = heavy.groupBy("u").agg(F.sum("aa").alias("most_aa"), F.sum("ra").alias("most_ra"))
    rich = bound.where((F.col("most_aa") >= least_aa - slack) | (F.col("most_ra") >= least_ra - slack)).select("u")
    far = heavy.join(rich, "u", "left_semi")
    sides = [bound.select(F.col("u").alias(k), F.col("most_aa").alias(f"{k}_aa"), F.col("most_ra").alias(f"{k}_ra")) for k in ("a", "b")]
    bounded = near.join(sides[0], "a", "left").join(sides[1], "b", "left")
    more = {c: F.least(F.coalesce(f"a_{c}", F.lit(0.0)), F.coalesce(f"b_{c}", F.lit(0.0))) for c in ("aa", "ra")}
    close = bounded.where((F.col("aa") + more["aa"] >= least_aa - slack) | (F.col("ra") + more["ra"] >= least_ra - slack)).select("a", "b", "aa", "ra")
    by_pair = heavy.select("z", F.col("u").alias("a"), "aa", "ra")
    looked = close.select("a", "b").join(by_pair, "a").join(heavy.select("z", F.col("u").alias("b")), ["b", "z"]).select("a", "b", "aa", "ra")
    known = close.select("a", "b")
    both = close.union(looked).union(_wedges(far, far).join(known, ["a", "b"], "left_anti"))
    return _summed(both).where((F.col("aa") >= least_aa) | (F.col("ra") >= least_ra))


def link_structural(edges: DataFrame, connected: DataFrame, least_aa: float = 1.2, least_ra: float = 0.3, cap: int = 50, floor: int = 10) -> DataFrame:
    """(a, b, aa, ra, proposer, confidence) of the best predicted pairs that aren't connected."""
    enough = edges.agg(F.count("*").alias("n_edges")).where(F.col("n_edges") >= floor)
    scored = strong_scores(edges, least_aa, least_ra).crossJoin(F.broadcast(enough)).drop("n_edges")  # a row or none
    top = scored.orderBy(F.desc(F.round(F.col("aa") + 4 * F.col("ra"), 9)), "a", "b").limit(cap)
    by_aa = F.greatest(F.lit(0.3), F.least(F.lit(0.7), F.col("aa") / 5))
    by_ra = F.greatest(F.lit(0.3), F.least(F.lit(0.7), F.col("ra") / 1.2))
    is_aa, is_ra = F.col("aa") >= least_aa, F.col("ra") >= least_ra
    proposer = F.when(is_aa & is_ra, "linker:agreement").when(is_aa, "linker:adamic_adar").otherwise("linker:resource_allocation")
    confidence = F.when(is_aa & is_ra, F.least(F.greatest(by_aa, by_ra) + 0.1, F.lit(0.8))).when(is_aa, by_aa).otherwise(by_ra)
    return top.join(canonical(connected), ["a", "b"], "left_anti").select("a", "b", "aa", "ra", proposer.alias("proposer"), confidence.alias("confidence"))


@dataclass(frozen=True)
class Rule:
    """A Horn rule: `build` gives (subject_id, object_id) from live positive facts.

    It's told the pairs that don't count (subject_id, object_id) and how many conclusions are wanted,
    least first, and may leave out what can't be among these.
    """

    name: str
    predicate: str
    symmetric: bool
    confidence: float
    build: Callable[[DataFrame, DataFrame, int], DataFrame]


def shared_object(predicate: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Subjects that have an object of `predicate` in common.

    Their pairs grow with the square of an object's subjects, but only the least are wanted.  A subject
    that isn't the greatest of some object, and of which no pair is left out, has a conclusion of its
    own; so the `cap` least of these bound the first subject, and only those up to there are paired.
    """

    def build(fact: DataFrame, excluded: DataFrame, cap: int) -> DataFrame:
        f = fact.where(F.col("predicate") == predicate).select("subject_id", "object_id").where("object_id IS NOT NULL").distinct()
        member = f.select("subject_id").distinct()
        least, greatest = F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id")
        within = excluded.select(least.alias("subject_id"), greatest.alias("other")).join(member, "subject_id", "left_semi").join(member.select(F.col("subject_id").alias("other")), "other", "left_semi")
        top = f.groupBy("object_id").agg(F.max("subject_id").alias("top"))
        sure = f.join(top, "object_id").where("subject_id < top").select("subject_id").distinct().join(within, "subject_id", "left_anti")
        bound = sure.orderBy("subject_id").limit(cap).agg(F.when(F.count("*") == cap, F.max("subject_id")).alias("bound"))  # one row
        some = f.crossJoin(F.broadcast(bound)).where("bound IS NULL OR subject_id <= bound").select("subject_id", "object_id")
        g = f.select(F.col("subject_id").alias("other"), "object_id")
        return some.join(g, "object_id").where("subject_id < other").select("subject_id", F.col("other").alias("object_id"))

    return build


def inherited(first: str, second: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """`first`(x, y) and `second`(x, z) give (y, z)."""

    def build(fact: DataFrame, excluded: DataFrame, cap: int) -> DataFrame:
        a = fact.where(F.col("predicate") == first).select("subject_id", F.col("object_id").alias("y")).distinct()
        b = fact.where(F.col("predicate") == second).select("subject_id", F.col("object_id").alias("z")).distinct()
        return a.join(b, "subject_id").where("y <> z").select(F.col("y").alias("subject_id"), F.col("z").alias("object_id"))

    return build


def partners_share(pair: str, held: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """`pair`(x, y) and `held`(x or y, z) give the other partner and z: a union of two equality joins."""

    def build(fact: DataFrame, excluded: DataFrame, cap: int) -> DataFrame:
        p = fact.where(F.col("predicate") == pair).select("subject_id", "object_id").distinct()
        h = fact.where(F.col("predicate") == held).select(F.col("subject_id").alias("owner"), F.col("object_id").alias("z")).distinct()
        ways = [p.join(h, F.col(own) == F.col("owner")).select(F.col(other).alias("subject_id"), F.col("z").alias("object_id")) for own, other in (("subject_id", "object_id"), ("object_id", "subject_id"))]
        return ways[0].union(ways[1]).where("subject_id <> object_id")

    return build


RULES = (
    Rule("coauthors", "collaborates_with", True, 0.7, shared_object("authored")),
    Rule("project mates", "works_with", True, 0.6, shared_object("works_on")),
    Rule("mentees join", "member_of", False, 0.55, inherited("mentors", "member_of")),
    Rule("collaborators share projects", "works_on", False, 0.5, partners_share("collaborates_with", "works_on")),
)


def run_rule(rule: Rule, fact: DataFrame, candidate: DataFrame, cap: int = 25) -> DataFrame:
    """At most `cap` new conclusions of a rule; neither a live fact or its denial, nor asked before.

    `candidate` is (proposer, predicate, subject_id, object_id) of all candidates so far.
    """
    live = fact.where(fn.is_live())
    known = live.where(F.col("predicate") == rule.predicate).select("subject_id", "object_id")
    if rule.symmetric:
        known = known.union(known.select("object_id", "subject_id"))
    asked = candidate.where((F.col("proposer") == f"rule:{rule.name}") & (F.col("predicate") == rule.predicate)).select("subject_id", "object_id")
    excluded = known.union(asked).distinct()
    drawn = rule.build(live.where("polarity = 'positive'"), excluded, cap).select("subject_id", "object_id").distinct()
    fresh = drawn.join(excluded, ["subject_id", "object_id"], "left_anti")
    top = fresh.orderBy("subject_id", "object_id").limit(cap)
    return top.select(F.lit(f"rule:{rule.name}").alias("proposer"), F.lit(rule.predicate).alias("predicate"), "subject_id", "object_id", F.lit(rule.confidence).alias("confidence"))


def run_rules(fact: DataFrame, candidate: DataFrame, rules: tuple[Rule, ...] = RULES, cap: int = 25) -> DataFrame:
    return reduce(DataFrame.unionByName, [run_rule(r, fact, candidate, cap) for r in rules])


def attach_derivation(pairs: DataFrame, mention: DataFrame, episode: DataFrame) -> DataFrame:
    """(a, b, sensitivity, anchor): the strictest tier of the shared episodes, and the newest of them.

    Mentions of the pairs' nodes meet by episode, and what they share by pair, in as many partitions as the
    mentions' size asks for; a node's mentions are never sorted in a task, nor joined with all of its pairs.
    """
    n = parts(mention)
    dates = episode.select("episode_id", "sensitivity", "occurred_at").repartition(n, "episode_id")
    dated = _chosen(_shared(_placed(mention, n, pairs)).join(dates, "episode_id"), n, pairs)
    return dated.groupBy("a", "b").agg(fn.tier_of(F.max(fn.sensitivity_rank(F.col("sensitivity")))).alias("sensitivity"), F.max_by("episode_id", F.struct("occurred_at", "episode_id")).alias("anchor"))


def edges_of(fact: DataFrame) -> DataFrame:
    live = fact.where(fn.is_live() & (F.col("polarity") == "positive") & F.col("object_id").isNotNull())
    return live.select("fact_id", "subject_id", "predicate", "object_id", "confidence")


def edges_from(fact: DataFrame, node_id: str) -> DataFrame:
    return edges_of(fact).where(F.col("subject_id") == node_id)


def edges_to(fact: DataFrame, node_id: str) -> DataFrame:
    return edges_of(fact).where(F.col("object_id") == node_id)


def neighborhood(fact: DataFrame, seeds: list[str], depth: int, predicates: list[str] | None = None, limit: int = 50) -> DataFrame:
    """(node_id, depth, via) within `depth` steps of the seeds, either way along edges.

    `via` is the fact by which a node is first reached: outgoing before incoming, then the least
    fact_id.  Two steps are one plan; further frontiers are written, so that no step computes
    those before it again.
    """
    e = edges_of(fact)
    if predicates:
        e = e.where(F.col("predicate").isin(*predicates))
    out = e.select(F.col("subject_id").alias("from"), F.col("object_id").alias("to"), F.lit(0).alias("way"), "fact_id")
    steps = out.union(e.select(F.col("object_id").alias("from"), F.col("subject_id").alias("to"), F.lit(1).alias("way"), "fact_id"))
    spark = fact.sparkSession
    seen = spark.createDataFrame([(s,) for s in seeds], "node_id string").select("node_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.select(F.col("node_id").alias("from")).join(steps, "from").join(seen.select(F.col("node_id").alias("to")), "to", "left_anti")
        frontier = reached.groupBy(F.col("to").alias("node_id")).agg(F.min_by("fact_id", F.struct("way", "fact_id")).alias("via")).select("node_id", F.lit(d).alias("depth"), "via")
        if d > 1 and d < depth:
            frontier = written(frontier, "frontier")
        seen = seen.union(frontier)
    return seen.where("depth > 0").orderBy("depth", "node_id").limit(limit)


def scope_chain(parent: DataFrame, node_id: str, most: int = 10) -> DataFrame:
    """(node_id, level) from the root (the greatest level) to the node (0); cycles end the walk."""
    spark = parent.sparkSession
    last = spark.createDataFrame([(node_id, 0, [node_id])], "node_id string, level int, path array<string>")
    levels = [last]
    for k in range(1, most):
        up = last.select(F.col("node_id").alias("child"), "path").join(parent.select(F.col("node_id").alias("child"), "parent_id"), "child").where(~F.array_contains("path", F.col("parent_id")))
        last = up.select(F.col("parent_id").alias("node_id"), F.lit(k).alias("level"), F.concat("path", F.array("parent_id")).alias("path"))
        levels.append(last)
    return reduce(DataFrame.union, levels).select("node_id", "level")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
