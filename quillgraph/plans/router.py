"""From a question to a pack: what it asks for is read off the question on the driver, and the
answer is one lazy DataFrame of items within a token budget."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates, facts, retrieval
from ..session import written

MONTHS = "january february march april may june july august september october november december".split()
ITEMS = "query_id string, kind string, id string, text string, score double, push_order bigint"


@dataclass(frozen=True)
class Lens:
    """Restrictions that the caller puts on a question."""

    scope: str = "both"  # facts, evidence or both
    sources: tuple[str, ...] | None = None  # an empty tuple matches nothing
    start: dt.datetime | None = None
    end: dt.datetime | None = None

    @property
    def is_default(self) -> bool:
        return self == Lens()


@dataclass(frozen=True)
class Question:
    text: str
    tags: tuple[str, ...]
    start: dt.datetime | None
    end: dt.datetime | None
    intent: str
    channel: str | None = None


def extract_time(text: str, now: dt.datetime) -> tuple[str, dt.datetime | None, dt.datetime | None]:
    """(text without the phrase, start, end) of a named period; half-open."""
    day = dt.datetime(now.year, now.month, now.day)
    week, month, one = day - dt.timedelta(days=day.weekday()), day.replace(day=1), dt.timedelta(days=1)
    named = {  # "last" weeks and months are the days up to now, left open
        "today": (day, day + one), "yesterday": (day - one, day), "this week": (week, week + 7 * one), "last week": (day - 7 * one, None),
        "this month": (month, (month + 32 * one).replace(day=1)), "last month": (day - 31 * one, None), "this year": (day.replace(month=1, day=1), day.replace(year=day.year + 1, month=1, day=1)),
        "last year": (day.replace(year=day.year - 1, month=1, day=1), day.replace(month=1, day=1)),
    }
    low = text.lower()
    for phrase, (a, b) in named.items():
        if m := re.search(rf"\b{phrase}\b", low):
            return _without(text, m), a, b
    if m := re.search(r"\b(?:in the )?(?:last|past) (\d{1,4}) (day|week|month)s?\b", low):
        span = int(m[1]) * {"day": 1, "week": 7, "month": 30}[m[2]]
        return _without(text, m), day - span * one, day + one
    if m := re.search(r"\bsince (\d{4}-\d{2}-\d{2})\b", low):
        return _without(text, m), dt.datetime.fromisoformat(m[1]), None
    if m := re.search(r"\b(?:on )?(\d{4}-\d{2}-\d{2})\b", low):
        a = dt.datetime.fromisoformat(m[1])
        return _without(text, m), a, a + one
    years = [y for y in re.finditer(r"(?<!\d)(\d{4})(?!\d)", low) if 2000 <= int(y[1]) <= 2100]
    if m := re.search(rf"\b(?:in|during) ({'|'.join(MONTHS)})(?: (\d{{4}}))?\b", low):
        k = MONTHS.index(m[1]) + 1
        year = int(m[2]) if m[2] else int(years[0][1]) if years else now.year - (k > now.month)
        a = dt.datetime(year, k, 1)
        return _without(text, m), a, (a + 32 * one).replace(day=1)
    if years:
        m = re.search(rf"(?:\b(?:in|during) )?(?<!\d){years[0][1]}(?!\d)", low)
        year = int(years[0][1])
        return _without(text, m), dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    return text, None, None


def _without(text: str, m: re.Match) -> str:
    return " ".join((text[: m.start()] + " " + text[m.end() :]).split())


def extract_tags(text: str, vocabulary: set[str]) -> tuple[str, tuple[str, ...]]:
    """(text, tags): known tags leave the text, unknown ones stay as words."""
    tags = tuple(dict.fromkeys(t.lower() for t in re.findall(r"(?<!\w)#([\w-]+)", text) if t.lower() in vocabulary))
    rest = re.sub(r"(?<!\w)#([\w-]+)", lambda m: "" if m[1].lower() in vocabulary else m[1], text)
    return " ".join(rest.split()), tags


LOOKUP = ("when did i last", "when was the last", "last time i", "last meet", "last spoke", "last talk", "last email", "how long since")
AGGREGATE = (
    "how many", "how much", "how often", "count ", "per week", "per month", "trend", "most frequent", "which projects", "stalled", "with the most", "to the most", "most often", "most interactions", "most time with",
)
PEOPLE = ("who ", "people", "person", "with the most", "to the most", "most interactions", "most time with")
#: (cues, channel) in the order in which a lookup tries them.
CHANNELS = ((("meet", "met ", "saw"), "meeting"), (("email",), "email"), (("spoke", "talk", "conversation"), "spoken"), (("slack",), "slack"), (("text", "message"), "message"))


def classify(text: str) -> tuple[str, str | None]:
    """(intent, channel): lookup of a last contact, an aggregate (people, stalled projects, counts), or recall."""
    low = text.lower()
    if any(m in low for m in LOOKUP):
        return "lookup", next((channel for cues, channel in CHANNELS if any(c in low for c in cues)), None)
    if any(m in low for m in AGGREGATE):
        if "stalled" in low or "which projects" in low:
            return "projects", None
        if "most" in low and any(m in low for m in PEOPLE):
            return "people", None
        return "count", None
    return "recall", None


def read(text: str, now: dt.datetime, vocabulary: set[str] = frozenset(), lens: Lens = Lens()) -> Question:
    rest, tags = extract_tags(text, set(vocabulary))
    rest, start, end = extract_time(rest, now)
    intent, channel = classify(text)
    return Question(rest, tags, lens.start or start, lens.end or end, intent, channel)


@dataclass(frozen=True)
class Store:
    """The tables that questions are put to."""

    episode: DataFrame
    nodes: DataFrame
    mention: DataFrame
    fact: DataFrame
    names: DataFrame  # name, node_id, node_type
    vectors: DataFrame | None = None  # id, embedding
    tagged: DataFrame | None = None  # episode_id, tag
    extra: dict = field(default_factory=dict)


def _literal(t: dt.datetime | None):
    return None if t is None else F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _items(df: DataFrame, kind: str, id_: str, text, score, order) -> DataFrame:
    return df.select(F.lit("q").alias("query_id"), F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), text.alias("text"), score.cast("double").alias("score"), order.cast("bigint").alias("push_order"))


LABELS = {"meeting": "last met", "email": "last email", "spoken": "last spoken", "slack": "last slack", "message": "last message", None: "last seen"}


def ask(
    spark: SparkSession, store: Store, text: str, now: dt.datetime, k: int = 10, budget: int = 4000, lens: Lens = Lens(), include_private: bool = False, query_vector: list[float] | None = None,
    types: tuple[str, ...] | None = None, touch: DataFrame | None = None,
) -> tuple[Question, DataFrame]:
    """(how the question was read, items of its pack).

    The entities named are found on the driver, as they decide the shape of the plan; all else is
    one plan.  A name of several nodes and no other entity gives no items: the caller must ask.  `types`
    keeps items of these kinds only; `touch` (id, touches, first_at) lets what was shown often rank higher.
    """
    vocabulary = {r.tag for r in store.tagged.select("tag").distinct().collect()} if store.tagged is not None else set()
    q = read(text, now, vocabulary, lens)
    row = spark.createDataFrame([("q", q.text)], "query_id string, text string")
    found = retrieval.detect_entities(row, store.names).orderBy(F.desc(F.char_length("name")), "name").collect()
    entity = next((r.node_id for r in found if not r.ambiguous), None)
    none = spark.createDataFrame([], ITEMS)
    if entity is None and any(r.ambiguous for r in found):
        return replace(q, intent="ambiguous"), none
    start, end = _literal(q.start), _literal(q.end)
    as_of = _literal(now)
    if q.intent == "lookup" and entity and lens.scope != "evidence":
        ids = [r.node_id for r in found if not r.ambiguous]
        asked = store.nodes.where(F.col("node_id").isin(*ids)).select("node_id", "name")
        rollup = aggregates.person_interactions(store.episode, store.mention.where(F.col("node_id").isin(*ids)), store.nodes, as_of)
        column = F.greatest("last_meeting_at", "last_spoken_at") if q.channel == "meeting" else F.col(f"last_{q.channel}_at") if q.channel else F.col("last_at")
        label = LABELS[q.channel]
        known = F.concat(F.col("name"), F.lit(f": {label}: "), F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit(" ("), F.col("interactions").cast("string"), F.lit(" interactions, last channel "), "last_channel", F.lit(")"))
        said = F.when(column.isNotNull(), known).otherwise(F.concat(F.col("name"), F.lit(f": no recorded {label}")))
        place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("node_id"))
        return q, _items(asked.join(rollup, "node_id", "left"), "person_interaction", "node_id", said, F.lit(1.0), place)
    if q.intent == "projects" and lens.scope != "evidence":
        idle = facts.stalled_projects(store.nodes.where("node_type = 'project'"), store.mention, store.episode, as_of)
        return q, _items(idle, "aggregate", "node_id", F.concat(F.lit("stalled: "), "name"), F.lit(1.0), F.row_number().over(Window.orderBy("node_id")))  # projects are few
    if q.intent == "people" and lens.scope != "evidence":
        if start is not None and end is not None:
            top = aggregates.people_ranking_in_range(store.episode, store.mention, store.nodes, start, end, k)
        else:
            top = aggregates.people_ranking(aggregates.person_interactions(store.episode, store.mention, store.nodes, as_of), store.nodes, k)
        return q, _items(top, "aggregate", "node_id", F.concat_ws(": ", "name", F.col("interactions").cast("string")), F.col("interactions"), F.lit(0))
    if q.intent == "count" and lens.scope != "evidence":
        e = store.episode if entity is None else store.episode.join(store.mention.where(F.col("node_id") == entity).select("episode_id").distinct(), "episode_id", "left_semi")
        by = aggregates.source_counts(e, start, end)
        return q, _items(by, "aggregate", "source", F.concat_ws(": ", "source", F.col("n").cast("string")), F.col("n"), F.lit(0))
    tagged = store.tagged.where(F.col("tag").isin(*q.tags)).groupBy("episode_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(q.tags)) if q.tags else None
    allowed = retrieval.candidates(store.episode, store.mention, entity, None if lens.sources is None else list(lens.sources), tagged, include_private)
    allowed = allowed.where(aggregates.in_range(start, end))
    qv = spark.createDataFrame([("q", query_vector)], "query_id string, qv array<double>") if query_vector is not None else None
    docs = allowed.select(F.col("episode_id").alias("id"), F.col("body").alias("text"))
    hits = retrieval.hybrid(docs, store.vectors, row, qv, k)
    evidence = _items(hits.join(docs, "id"), "episode", "id", F.substring("text", 1, 700), F.col("score"), 1000 + F.col("rank"))
    back = retrieval.anchored_fallback(allowed, start, end, k) if (q.tags or q.start or entity) else None
    parts = [evidence]
    if back is not None:  # only where nothing was found
        spare = _items(back.join(allowed.select("episode_id", "body"), "episode_id"), "episode", "episode_id", F.substring("body", 1, 700), F.col("score"), 2000 + F.col("episode_id"))
        parts.append(spare.join(evidence.select("query_id").distinct(), "query_id", "left_anti"))
    if lens.scope != "evidence":
        live = retrieval.hybrid_facts(store.fact, row, min(k, 10), include_private)
        parts.append(_items(live.join(store.fact.select(F.col("fact_id").alias("id"), "statement"), "id"), "fact", "id", F.col("statement"), F.col("score"), F.col("rank")))
    items = parts[0]
    for p in parts[1:]:
        items = items.union(p)
    if types is not None:
        items = items.where(F.col("kind").isin(*types))
    if touch is not None:
        items = retrieval.with_activation(items, touch.select("id", "touches", "first_at"), as_of).select(*[c.split()[0] for c in ITEMS.split(", ")])
    return q, retrieval.pack(items, budget).orderBy(F.desc("score"), "push_order")


@dataclass(frozen=True)
class Pack:
    """An answer: its items, warnings about their facts, how well the question was covered, and what is to be logged."""

    question: Question
    items: DataFrame
    flags: DataFrame | None
    coverage: DataFrame
    ledger: DataFrame  # kind, subject, payload, at: empty for a probe's lens or without a tool


def answer(
    spark: SparkSession, store: Store, text: str, now: dt.datetime, tool: str | None = None, observation: DataFrame | None = None, half_lives: DataFrame | None = None, lens: Lens = Lens(), **options,
) -> Pack:
    """The whole pack of a question; with `observation` and `half_lives` its facts are checked.

    Only questions of a tool without a lens are logged: one row for each item and flag, and one for the question.
    """
    question, items = ask(spark, store, text, now, lens=lens, **options)
    items = written(items, "pack")
    as_of = _literal(now)
    flags = None
    if observation is not None and half_lives is not None:
        named = items.where("kind = 'fact'").select("query_id", F.col("id").alias("fact_id"))
        flags = retrieval.flag_pack(named, store.fact, observation, store.episode, half_lives, as_of)
    coverage = retrieval.coverage_status(items, spark.createDataFrame([("q",)], "query_id string"))
    payload = [F.to_json(F.struct(F.lit(tool).alias("tool"), F.lit(text).alias("query"), *more)).alias("payload") for more in ([F.col("score")], [F.col("n"), F.col("status")], [F.col("kind"), F.col("predicate"), F.col("detail")])]
    log = items.select(F.concat(F.lit("shown:"), "kind").alias("kind"), F.col("id").alias("subject"), payload[0]).union(coverage.select(F.lit("question"), F.lit(question.intent), payload[1]))
    if flags is not None:
        log = log.union(flags.select(F.lit("flag_shown"), "subject_id", payload[2]))
    log = log.withColumn("at", as_of)
    return Pack(question, items, flags, coverage, log if tool and lens.is_default else log.where("false"))


def ask_as_of(store: Store, spark: SparkSession, text: str, t: dt.datetime, k: int = 25) -> DataFrame:
    """Facts about the entities of a question that held at a time."""
    row = spark.createDataFrame([("q", text)], "query_id string, text string")
    entities = retrieval.detect_entities(row, store.names).where("NOT ambiguous").select("node_id")
    then = facts.facts_as_of(store.fact, _literal(t)).join(entities.select(F.col("node_id").alias("subject_id")), "subject_id", "left_semi")
    return retrieval.rank_within(then, ["subject_id"], [F.desc("valid_from"), F.col("fact_id")], k).drop("rank")
