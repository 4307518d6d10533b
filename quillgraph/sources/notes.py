"""Markdown notes and conversation summaries, and gold query sets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import backlinks, slugify
from .base import COLUMNS, Source, whole_texts

NO_PEOPLE = "array<struct<email: string, name: string>>"


def title(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1)), F.lit(""))


def attribute_values(text: Column) -> Column:
    """(key, value) of `- Key: value` bullets, and of `- Key:` bullets with a row for each indented bullet under them, in order."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.rlike(x, F.lit(r"^\s*[-*] \S")))
    top = F.transform(lines, lambda x, i: F.struct(F.rlike(x, F.lit(r"^[-*] ")).alias("top"), F.lower(F.trim(F.regexp_extract(x, r"^[-*] ([^:]{1,40}):", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^\s*[-*] (?:[^:]{1,40}:(?= |$))?", "")).alias("v"), F.trim(F.regexp_replace(x, r"^\s*[-*] ", "")).alias("whole")))
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<struct<key: string, value: string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        key = F.when(x["top"], x["k"]).otherwise(state["key"])
        value = F.when(x["top"], x["v"]).otherwise(x["whole"])
        out = F.when((key != "") & (value != ""), F.concat(state["out"], F.array(F.struct(key.alias("key"), value.alias("value"))))).otherwise(state["out"])
        return F.struct(key.alias("key"), out.alias("out"))

    return F.aggregate(top, start, step)["out"]


def attributes(text: Column) -> Column:
    """The bullets of :func:`attribute_values` as a map; of equal keys the last counts."""
    pairs = attribute_values(text)
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])))


def zipped_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the Markdown files in zip archives, in the form of `whole_texts`; each archive is read by one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows = [(f"{name}!/{m.filename}", archive.read(m).decode("utf-8", "replace")) for m in archive.infolist() if m.filename.endswith(".md")]
                yield pd.DataFrame(rows, columns=["path", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, value string")


def linked_nodes(episode: DataFrame, names: DataFrame) -> DataFrame:
    """(episode_id, node_id): the nodes of one name (name, node_id) that a note's backlinks name."""
    links = episode.select("episode_id", F.explode(F.from_json(F.get_json_object("meta", "$.links"), "array<string>")).alias("link"))
    return links.join(names, F.lower(F.trim("link")) == F.col("name")).select("episode_id", "node_id").distinct()


def promoted(episode: DataFrame) -> dict[str, DataFrame]:
    """What typed notes say, for the writes of `graph` and `facts`.

    ``person`` (episode_id, name, emails, phones), ``org`` (episode_id, name, domains), ``document``
    (episode_id, name), by the note's `Type`; ``claim`` (episode_id, subject, predicate, object, object_type,
    object_value, statement, confidence); ``untyped`` (episode_id, name) attach to a node of that name.
    Subjects and objects are names.
    """
    n = episode.select("episode_id", title(F.col("body")).alias("name"), F.explode(F.array(attribute_values(F.col("body")))).alias("a")).where("name IS NOT NULL")

    def values(key: str) -> Column:
        return F.transform(F.filter("a", lambda p: p["key"] == key), lambda p: p["value"])

    kind = F.lower(F.regexp_replace(F.get(values("type"), F.lit(0)), "^#+", ""))
    n = n.withColumn("type", kind)
    person, org, document = n.where("type IN ('person', 'author')"), n.where("type = 'company'"), n.where("type = 'book'")
    bare = lambda c: F.trim(F.regexp_replace(c, r"\[\[|\]\]", ""))
    phones = F.filter(F.transform(values("phone"), lambda v: F.regexp_replace(v, "[^0-9+]", "")), lambda v: F.length(v) >= 7)

    def claims(rows: DataFrame, key: str, predicate: str, says: str, confidence: float, object_type: str | None = None, turned: bool = False) -> DataFrame:
        each = rows.select("episode_id", "name", F.explode(values(key)).alias("v")).withColumn("v", bare(F.col("v")) if object_type or turned else F.col("v")).where("v <> ''")
        subject, other = ("v", "name") if turned else ("name", "v")
        null = F.lit(None).cast("string")
        return each.select(
            "episode_id", F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), (F.col(other) if object_type else null).alias("object"), F.lit(object_type).cast("string").alias("object_type"),
            (null if object_type else F.col(other)).alias("object_value"), F.concat(F.col(subject), F.lit(f" {says} "), F.col(other), F.lit(".")).alias("statement"), F.lit(confidence).alias("confidence"),
        )

    every = claims(person, "company", "works_at", "works at", 0.9, "org").union(claims(person, "title", "has_role", "is", 0.9)).union(claims(person, "location", "located_in", "is located in", 0.8)).union(claims(document, "author", "authored", "authored", 0.9, "document", True))
    return {
        "person": person.select("episode_id", "name", F.filter(F.transform(values("email"), F.lower), lambda v: F.contains(v, F.lit("@"))).alias("emails"), phones.alias("phones")),
        "org": org.select("episode_id", "name", F.filter(F.transform(values("domain"), lambda v: F.lower(bare(v))), lambda v: F.contains(v, F.lit("."))).alias("domains")),
        "document": document.select("episode_id", "name"), "claim": every, "untyped": n.where("type IS NULL OR type NOT IN ('person', 'author', 'company', 'book')").select("episode_id", "name"),
    }


def written_note(spark: SparkSession, body: str, at: str, tags: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(episode, annotations) of a note that the user writes; its identifier is a hash of time and text."""
    row = spark.createDataFrame([(body.strip(), at)], "body string, at string").where("body <> ''")
    key = F.substring(F.sha2(F.concat_ws("\u0001", "at", "body"), 256), 1, 16)
    episode = row.select(
        F.lit("note").alias("source"), key.alias("source_id"), "body", F.col("at").cast("timestamp_ntz").alias("occurred_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_end"), F.lit("personal").alias("sensitivity"),
        F.lit(None).cast(NO_PEOPLE).alias("people"), F.lit(None).cast("string").alias("meta"),
    ).select(*COLUMNS)
    tag = row.select(key.alias("source_id"), F.explode(F.array(*[F.lit(t) for t in tags]).cast("array<string>")).alias("body")).select("source_id", F.lit("tag").alias("kind"), "body")
    return episode, tag


class Notes(Source):
    """A folder or zip archive of notes; files named YYYY-MM-DD.md are daily."""

    id = "notes"

    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
        day = F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})$", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
        texts = zipped_notes(spark, self.path) if self.path.endswith(".zip") else whole_texts(spark, self.path)
        n = texts.select(name.alias("name"), day.alias("day"), F.col("value").alias("body"))
        key = F.coalesce(F.date_format("day", "yyyy-MM-dd"), slugify(F.coalesce(title(F.col("body")), F.col("name"))))
        out = n.select(
            F.when(F.col("day").isNotNull(), "notes.daily").otherwise("notes.page").alias("source"), key.alias("source_id"), "body", F.col("day").alias("occurred_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_end"),
            F.lit("personal").alias("sensitivity"), F.lit(None).cast(NO_PEOPLE).alias("people"), F.to_json(F.struct(title(F.col("body")).alias("title"), backlinks(F.col("body")).alias("links"))).alias("meta"),
        ).select(*COLUMNS)
        return out.where(F.col("occurred_at").isNull() | (F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz"))) if since else out


def section(text: Column, heading: str) -> Column:
    """The text under a heading of any level up to the next heading."""
    found = F.regexp_extract(text, rf"(?ms)^#+ {heading}\s*\n(.*?)(?=^#|\z)", 1)
    return F.nullif(F.regexp_replace(found, r"^\s+|\s+$", ""), F.lit(""))


class Conversations(Source):
    """Summaries of recorded conversations with `- start_time:` and `- end_time:` lines."""

    id = "bee.conversation"

    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        t = whole_texts(spark, self.path).select("path", F.regexp_replace("value", "\r", "").alias("t"))

        def stamp(key: str) -> Column:
            return F.try_to_timestamp(F.nullif(F.regexp_extract("t", rf"(?m)^- {key}: *(\S[^\n]*)$", 1), F.lit(""))).cast("timestamp_ntz")

        takeaways = F.regexp_extract_all(F.coalesce(section(F.col("t"), "Key Takeaways"), F.lit("")), F.lit(r"(?m)^[-*] +(.+)$"), F.lit(1))
        short, long = section(F.col("t"), "Short Summary"), section(F.col("t"), "Summary")
        out = t.select(
            F.lit(self.id).alias("source"), F.regexp_extract("t", r"(?m)^# Conversation (\S+)", 1).alias("source_id"), F.concat_ws("\n\n", short, long).alias("body"), stamp("start_time").alias("occurred_at"), stamp("end_time").alias("occurred_end"),
            F.lit("private").alias("sensitivity"), F.lit(None).cast(NO_PEOPLE).alias("people"), F.to_json(F.struct(takeaways.alias("takeaways"))).alias("meta"),
        ).where("source_id <> ''").select(*COLUMNS)
        return out.where(F.col("occurred_at") > F.lit(since).cast("timestamp_ntz")) if since else out


PAGE = "conversations array<struct<id: string, start_time: string, end_time: string, short_summary: string, summary: string, state: string, primary_location: struct<address: string, latitude: double, longitude: double>>>"


def conversation_pages(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of a folder of JSON pages that list conversations; of several listings of one the longest counts."""
    c = spark.read.option("multiLine", True).schema(PAGE).json(path).select(F.explode("conversations").alias("c")).select("c.*").where("id IS NOT NULL")
    body = F.concat_ws("\n\n", "short_summary", "summary")
    one = c.withColumn("body", body).groupBy("id").agg(F.max_by(F.struct("body", "start_time", "end_time", "state", "primary_location"), F.struct(F.length("body"), F.col("body"))).alias("c"))
    place = F.struct(F.col("c.primary_location.address").alias("place"), F.col("c.primary_location.latitude").alias("latitude"), F.col("c.primary_location.longitude").alias("longitude"), F.col("c.state").alias("state"))
    return one.select(
        F.lit("bee.conversation").alias("source"), F.col("id").alias("source_id"), "c.body", F.try_to_timestamp("c.start_time").cast("timestamp_ntz").alias("occurred_at"), F.try_to_timestamp("c.end_time").cast("timestamp_ntz").alias("occurred_end"),
        F.lit("private").alias("sensitivity"), F.lit(None).cast(NO_PEOPLE).alias("people"), F.to_json(place).alias("meta"),
    ).select(*COLUMNS)


def lacking(episode: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, source_id) of recorded conversations whose page says more than their episode does: what to fetch in full."""
    key = ["source", "source_id"]
    return pages.select(*key, F.length("body").alias("n")).join(episode.select(*key, F.length("body").alias("have")), key, "left").where("have IS NULL OR have < n").select(*key)


def suggested_facts(fact: DataFrame) -> DataFrame:
    """Candidates for `triage.propose` of a wearable's facts (id, text, tags): unvetted, and with the identifier to answer to."""
    payload = F.to_json(F.struct(F.col("id").cast("string").alias("bee_fact_id"), F.array_join("tags", ",").alias("tags")))
    return fact.select(F.lit("bee:suggested").alias("proposer"), F.lit("related_to").alias("predicate"), F.lit("").alias("subject"), F.col("text").alias("statement"), F.lit(0.5).alias("confidence"), payload.alias("payload"))


def pending_pushes(candidate: DataFrame) -> DataFrame:
    """(candidate_id, bee_fact_id, confirmed) of the decided ones that the wearable hasn't been told of."""
    fact_id, pushed = (F.get_json_object("payload", f"$.{k}") for k in ("bee_fact_id", "bee_pushed"))
    done = candidate.where(F.col("status").isin("accepted", "rejected")).where(fact_id.isNotNull() & pushed.isNull())
    return done.select("candidate_id", fact_id.alias("bee_fact_id"), (F.col("status") == "accepted").alias("confirmed"))


def resolve_expect(gold: DataFrame, episode: DataFrame) -> DataFrame:
    """(query, job, expect): each expected identifier, `source:source_id` as its episode's where there is one."""
    each = gold.select("query", "job", F.explode("expect_ids").alias("expect"))
    known = episode.select(F.concat_ws(":", "source", "source_id").alias("expect"), F.col("episode_id").cast("string").alias("own"))
    return each.join(known, "expect", "left").select("query", "job", F.coalesce("own", "expect").alias("expect"))


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, job, expect_ids, expect_contains, note) of JSON lines; lines that begin with # are comments."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    schema = "query string, job string, expect_ids array<string>, expect_contains string, note string"
    return lines.select(F.from_json("value", schema).alias("g")).select("g.*")
