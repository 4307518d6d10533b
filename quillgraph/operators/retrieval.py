"""Lexical and vector retrieval for many queries at once, rank fusion, and token-bounded packs.

Queries are rows like anything else: the postings are joined with all queries' terms, scores are
summed by (query, document), and the best of each query are taken by rank within the query.
Candidate filters come before ranking, so that a hidden or foreign row can't push out a fit one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions.porter import known_stem, porter
from ..session import parts, written
from .aggregates import stale_facts
from .link import name_hits, rank_within, with_words

RRF_K = 60
STOP_WORDS = tuple("about and did does for from has have how last many meet month much said say tell that the this time today told was week were what when who with year yesterday".split())


@dataclass(frozen=True)
class Index:
    """A written full-text index: postings (term, id, tf, dl) sorted by term, and one row of totals."""

    postings: DataFrame
    totals: DataFrame
    stemmed: bool


def _counted(stemmed: bool):
    """Batches of (id, said) to (term, id, tf, dl), a few documents at a time; each distinct word is stemmed once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                terms, at, tf, dl = [], [], [], []
                for k, said in enumerate(piece.column(1).to_pylist()):
                    if said is None:
                        continue
                    words = Counter(said.split(" "))
                    words.pop("", None)
                    n = words.total()
                    if stemmed:
                        stems: Counter = Counter()
                        for word, m in words.items():
                            stems[known_stem(word)] += m
                        words = stems
                    terms += words.keys()
                    tf += words.values()
                    at += [k] * len(words)
                    dl += [n] * len(words)
                yield pa.record_batch([pa.array(terms, pa.string()), piece.column(0).take(pa.array(at, pa.int32())), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], ["term", "id", "tf", "dl"])

    return run


def _words(docs: DataFrame, text: str, stemmed: bool) -> DataFrame:
    words = with_words(docs.select("id", text), text).select("id", F.filter("words", lambda w: w != "").alias("words"))
    return words.select("id", porter(F.col("words")).alias("words")) if stemmed else words


def postings(docs: DataFrame, text: str = "text", stemmed: bool = False) -> DataFrame:
    """(term, id, tf, dl) of `docs` (id, text), whose identifiers are unique; dl counts all of a document's words, stemmed or not.

    A document's words are counted within its row, so that nothing is shuffled.
    """
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", fn.normalize(F.col(text)).alias("said")).mapInArrow(_counted(stemmed), f"term string, id {kind}, tf int, dl int")


def build_index(docs: DataFrame, text: str = "text", stemmed: bool = True) -> Index:
    """Split and count the texts once, and keep the result in the shared folder.

    Rows are sorted by term in each file, so that a search reads the row groups of its terms only.  A term of many
    documents lies in several files, and files are as many as the texts' size asks for.
    """
    spread = F.pmod(F.xxhash64("id"), F.lit(16))
    kept = written(postings(docs, text, stemmed).repartition(parts(docs, 2), F.col("term"), spread).sortWithinPartitions("term", "id"), "postings")
    n_docs = docs.agg(F.count("*").cast("double").alias("n_docs"))
    totals = written(kept.agg(F.sum("tf").cast("double").alias("n_words")).crossJoin(F.broadcast(n_docs)).select("n_docs", (F.col("n_words") / F.col("n_docs")).alias("avg_dl")), "postings-totals")  # one row
    return Index(kept, totals, stemmed)


def _query_terms(queries: DataFrame, stemmed: bool) -> DataFrame:
    terms = queries.select("query_id", F.explode(F.array(fn.query_terms(F.col("text")))).alias("terms"))
    if stemmed:
        terms = terms.select("query_id", porter(F.col("terms")).alias("terms"))
    return terms.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))


def _ranked(terms: DataFrame, counted: DataFrame, totals: DataFrame, k: int, n: int) -> DataFrame:
    """Postings meet by document in `n` partitions, where all queries' scores are summed and cut to the best k before they are shuffled."""
    df = counted.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weighted = counted.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # a row a term of the queries; one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avg_dl")))
    scores = F.broadcast(terms).join(weighted.select("term", "id", part.alias("part")).repartition(n, "id"), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return rank_within(scores, ["query_id"], [F.desc(F.round("score", 9)), F.col("id")], k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): best k for each of `queries` (query_id, text), from the postings of their terms."""
    terms = _query_terms(queries, index.stemmed)
    return _ranked(terms, index.postings.join(terms.select("term").distinct(), "term", "left_semi"), index.totals, k, parts(index.postings))


def bm25(docs: DataFrame, queries: DataFrame, k: int, text: str = "text", stemmed: bool = True) -> DataFrame:
    """:func:`search` in `docs` without an index: only the queries' terms are counted, and one row of totals."""
    words = _words(docs, text, stemmed)
    totals = words.agg(F.count("*").cast("double").alias("n_docs"), F.avg(F.size("words")).alias("avg_dl"))
    terms = _query_terms(queries, stemmed)
    hits = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return _ranked(terms, hits.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), totals, k, parts(docs))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank): exact nearest k of `vectors` (id, embedding) for each query (query_id, qv).

    Vectors and queries are cut into blocks of about `block` rows, and each pair of blocks is one product
    of matrices; of each the nearest k (and some more, as the product rounds) have their distance computed
    from the differences, and the best of all blocks are ranked.
    """
    names = [vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    n_left, n_right = (max(1, -(-n // block)) for n in (vectors.count(), queries.count()))
    left = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n_left)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("qb"), "id", F.col("embedding").cast("array<double>").alias("v"))
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_left - 1).cast("bigint"))).alias("vb"), F.pmod(F.xxhash64("query_id"), F.lit(n_right)).cast("int").alias("qb"), "query_id", F.col("qv").cast("array<double>").alias("v"))

    def best(a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": b["query_id"][:0], "id": a["id"][:0], "distance": []})
        x, y, n = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), min(k + 8, len(a))
        square = (y * y).sum(1)[:, None] + (x * x).sum(1) - 2 * y @ x.T
        near = np.argpartition(square, n - 1, 1)[:, :n]
        distance = np.sqrt(((x[near] - y[:, None, :]) ** 2).sum(2))
        return pd.DataFrame({"query_id": b["query_id"].to_numpy().repeat(n), "id": a["id"].to_numpy()[near.ravel()], "distance": distance.ravel()})

    pairs = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(best, f"query_id {names[1]}, id {names[0]}, distance double")
    return rank_within(pairs, ["query_id"], [F.round("distance", 9), F.col("id")], k)


def fuse(lexical: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, via, rank): reciprocal rank fusion of two rankings."""
    arms = lexical.select("query_id", "id", "rank", F.lit("bm25").alias("arm")).union(vector.select("query_id", "id", "rank", F.lit("vector").alias("arm")))
    score = F.sum(1.0 / (RRF_K + F.col("rank").cast("double")))
    via = F.when(F.countDistinct("arm") == 2, "both").otherwise(F.max("arm"))
    fused = arms.groupBy("query_id", "id").agg(score.alias("score"), via.alias("via"))
    return rank_within(fused, ["query_id"], [F.desc(F.round("score", 12)), F.col("id")], k)


def candidates(episode: DataFrame, mention: DataFrame | None = None, entity: str | None = None, sources: list[str] | None = None, tagged: DataFrame | None = None, include_private: bool = False) -> DataFrame:
    """Episodes that may be returned: of the entity, the sources and the tags, and not hidden.

    No list of sources is no restriction; an empty one matches nothing.
    """
    out = episode
    if not include_private:
        out = out.where(F.col("sensitivity").isin(*fn.SHOWN))
    if sources is not None:
        out = out.where(reduce(lambda a, b: a | b, [F.col("source").startswith(s) for s in sources], F.lit(False)))
    if entity is not None:
        out = out.join(mention.where(F.col("node_id") == entity).select("episode_id").distinct(), "episode_id", "left_semi")
    if tagged is not None:
        out = out.join(tagged.select("episode_id"), "episode_id", "left_semi")
    return out


def hybrid(docs: DataFrame, vectors: DataFrame | None, queries: DataFrame, query_vectors: DataFrame | None, k: int, stemmed: bool = True) -> DataFrame:
    """Best k of `docs` (id, text) for each query by fusion of both arms' best 3k, cut to 2k, then k.

    Without vectors or query vectors the lexical arm stands alone.
    """
    lexical = bm25(docs, queries, 3 * k, stemmed=stemmed)
    if vectors is None or query_vectors is None:
        vector = lexical.where("false").select("query_id", "id", "rank")
    else:
        vector = nearest(vectors.join(docs.select("id"), "id", "left_semi"), query_vectors, 3 * k)
    return fuse(lexical, vector, 2 * k).where(F.col("rank") <= k)


def hybrid_facts(fact: DataFrame, queries: DataFrame, k: int, include_private: bool = False, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """Live facts of both polarities by their statements and, with `vectors` (id, embedding), by these; no filter but sensitivity."""
    live = fact.where(fn.is_live())
    if not include_private:
        live = live.where(F.col("sensitivity").isin(*fn.SHOWN))
    return hybrid(live.select(F.col("fact_id").alias("id"), F.col("statement").alias("text")), vectors, queries, query_vectors, k)


def detect_entities(queries: DataFrame, names: DataFrame, longest: int = 5) -> DataFrame:
    """(query_id, name, node_id, ambiguous, candidates): names that occur in each query.

    `names` is (name, node_id, node_type) of canonical names and aliases.  A match inside a longer
    match is dropped; a name of several nodes is ambiguous.  Queries are cut into word runs and
    joined on equality, names of more than `longest` words by their first ones.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}.@]+", " "))
    words = queries.select("query_id", F.explode(F.array(F.transform(F.split(clean, " "), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")))).alias("words"))
    known = names.where(~F.col("node_type").isin(*fn.ANCHOR_LAST)).select(fn.canonicalize(F.col("name")).alias("name"), "node_id").distinct()
    known = known.where((F.char_length("name") >= 3) & ~F.col("name").isin(*STOP_WORDS))
    found = name_hits(words, "query_id", known.withColumnRenamed("name", "gram"), longest).withColumnRenamed("gram", "name")
    hits = found.groupBy("query_id", "name").agg(F.min("node_id").alias("node_id"), F.countDistinct("node_id").alias("candidates"))
    longer = hits.select(F.col("query_id").alias("q2"), F.col("name").alias("outer"))
    inside = (F.col("query_id") == F.col("q2")) & (F.char_length("outer") > F.char_length("name")) & (F.instr(F.concat(F.lit(" "), F.col("outer"), F.lit(" ")), F.concat(F.lit(" "), F.col("name"), F.lit(" "))) > 0)
    return hits.join(longer, inside, "left_anti").select("query_id", "name", "node_id", (F.col("candidates") > 1).alias("ambiguous"), "candidates")


def pack(items: DataFrame, budget: int) -> DataFrame:
    """The items of each query within a token budget: the first of equal texts, in order of score.

    The running total includes items that don't fit, so an oversize item ends the pack.
    `items` has query_id, push_order, score and text.
    """
    by_score = [F.desc("score"), F.col("push_order")]
    first = F.row_number().over(Window.partitionBy("query_id", fn.content_hash(F.col("text"))).orderBy(*by_score))
    kept = items.withColumn("_first", first).where("_first = 1").drop("_first").withColumn("tokens", fn.estimate_tokens(F.col("text")))
    spent = F.sum("tokens").over(Window.partitionBy("query_id").orderBy(*by_score).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("spent", spent).where(F.col("spent") <= budget)


def anchored_fallback(episode: DataFrame, start: Column | None, end: Column | None, k: int) -> DataFrame:
    from .aggregates import in_range

    shown = episode.where(F.col("sensitivity").isin(*fn.SHOWN) & in_range(start, end))
    return shown.orderBy(F.desc("occurred_at"), F.desc("episode_id")).limit(k).select("episode_id", "occurred_at", F.lit(0.01).alias("score"))


def with_activation(items: DataFrame, touch: DataFrame, as_of: Column, weight: float = 0.0004) -> DataFrame:
    """Scores nudged by how often and how recently an item was shown before."""
    life = fn.days_between(as_of, F.col("first_at"))
    nudge = F.when(F.col("touches").isNotNull(), weight * fn.activation(F.col("touches").cast("double"), life)).otherwise(F.lit(0.0))
    return items.join(touch, "id", "left").withColumn("score", F.col("score") + nudge).drop("touches", "first_at")


def flag_pack(pack_facts: DataFrame, fact: DataFrame, observation: DataFrame, episode: DataFrame, half_lives: DataFrame, as_of: Column, most: int = 2) -> DataFrame:
    """(query_id, kind, subject_id, predicate, detail): at most `most` warnings of each pack.

    Contradiction: another live positive object of a single-valued predicate.  Denial: a live
    negative fact of the same triple.  Staleness: evidence older than the predicate's half-life.
    """
    from .aggregates import SINGLE_VALUED

    shown = fact.where(fn.is_live() & F.col("sensitivity").isin(*fn.SHOWN))
    keys = pack_facts.select("query_id", "fact_id").join(fact.select("fact_id", "subject_id", "predicate", "object_id"), "fact_id")
    other = shown.select("subject_id", "predicate", F.col("object_id").alias("other_object"), "polarity", F.col("fact_id").alias("detail"))
    both = keys.join(other, ["subject_id", "predicate"])
    contradiction = both.where((F.col("polarity") == "positive") & F.col("predicate").isin(*SINGLE_VALUED) & (F.col("other_object") != F.col("object_id")))
    denial = both.where((F.col("polarity") == "negative") & (F.col("other_object") == F.col("object_id")))
    packed = pack_facts.select("fact_id").distinct()  # only what packs hold is dated
    own, seen = (df.join(packed, "fact_id", "left_semi") for df in (fact, observation))
    stale = keys.join(stale_facts(own, seen, episode, half_lives, as_of).select("fact_id"), "fact_id").withColumn("detail", F.col("fact_id"))
    kinds = ((0, "contradiction", contradiction), (1, "denial", denial), (2, "staleness", stale))
    flags = reduce(DataFrame.union, [df.select("query_id", F.lit(s).alias("severity"), F.lit(n).alias("kind"), "subject_id", "predicate", "detail") for s, n, df in kinds])
    one = flags.groupBy("query_id", "severity", "kind", "subject_id", "predicate").agg(F.min("detail").alias("detail"))
    return rank_within(one, ["query_id"], [F.col("severity"), F.col("subject_id"), F.col("predicate")], most).drop("rank")


def touch(shown: DataFrame) -> DataFrame:
    """(kind, id, touches, first_at, last_at) of the log of shown items; probes don't count."""
    return shown.where(~F.col("tool").endswith(".probe")).groupBy("kind", "id").agg(F.count("*").alias("touches"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def coverage_status(items: DataFrame, queries: DataFrame, thin: int = 3) -> DataFrame:
    """(query_id, n, status): empty, thin or covered."""
    n = queries.select("query_id").join(items.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("status", F.when(F.col("n") == 0, "empty").when(F.col("n") < thin, "thin").otherwise("covered"))


def suggest(partial: str, nodes: DataFrame, alias: DataFrame, k: int) -> DataFrame:
    """Nodes for a typed beginning: exact before prefix before infix, then type, use and name."""
    p = partial.lower().strip()
    both = nodes.select("node_id", fn.canonicalize(F.col("name")).alias("label")).union(alias.select("node_id", F.col("alias").alias("label")))
    tier = F.when(F.col("label") == p, 0).when(F.col("label").startswith(p), 1).when(F.contains("label", F.lit(p)), 2)
    best = both.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("node_id").agg(F.min("tier").alias("tier"))
    priority = F.when(F.col("node_type") == "person", 0).when(F.col("node_type") == "project", 1).when(F.col("node_type") == "org", 2).when(F.col("node_type") == "topic", 3).otherwise(4)
    return best.join(nodes, "node_id").orderBy("tier", priority, F.desc("access_count"), "name", "node_id").limit(k).select("node_id", "name", "tier")


def search_nodes(term: str, nodes: DataFrame, alias: DataFrame) -> DataFrame:
    t = F.lit(term.lower())
    named = nodes.where(F.contains(F.lower("name"), t)).select("node_id")
    also = alias.where(F.contains("alias", t)).select("node_id")
    return nodes.join(named.union(also).distinct(), "node_id", "left_semi")
