"""Chats and activity logs: rows are bucketed by conversation and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import apple_date_to_epoch, normalize_handle
from .base import COLUMNS, Source


def _days(lines: DataFrame, source: str, key: str, sensitivity: Column, most: int) -> DataFrame:
    """Episodes of lines (key, at, who, line, person): one for each key and day, lines in order."""
    day = lines.withColumn("day", F.to_date("at")).groupBy(key, "day")
    one = day.agg(
        F.sort_array(F.collect_list(F.struct("at", "who", "line"))).alias("parts"), F.min("at").alias("occurred_at"), F.max("at").alias("occurred_end"), F.array_distinct(F.array_compact(F.collect_list("person"))).alias("people"), F.max(sensitivity).alias("sensitivity")
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat_ws(": ", p["who"], p["line"])), "\n")
    return one.select(
        F.lit(source).alias("source"), F.concat_ws("#", F.col(key), F.col("day").cast("string")).alias("source_id"), F.substring(text, 1, most).alias("body"), "occurred_at", "occurred_end", "sensitivity",
        "people", F.to_json(F.struct(F.col(key).alias("channel"), F.size("parts").alias("messages"))).alias("meta"),
    ).select(*COLUMNS)


def messages_by_day(message: DataFrame, chat: DataFrame, link: DataFrame, handle: DataFrame) -> DataFrame:
    """Episodes of a phone's message tables: message(id, date, is_from_me, handle_id, text),
    chat(chat_id, name), link(chat_id, message_id), handle(handle_id, value)."""
    m = message.where(F.trim("text") != "").join(link, F.col("id") == F.col("message_id")).join(chat, "chat_id").join(handle, "handle_id", "left")
    value = normalize_handle(F.col("value"))
    at = F.timestamp_seconds(apple_date_to_epoch(F.col("date"))).cast("timestamp_ntz")
    lines = m.select(
        F.col("name").alias("chat"), at.alias("at"), F.when(F.col("is_from_me") == 1, "me").otherwise(value).alias("who"), F.substring("text", 1, 400).alias("line"),
        F.when((F.col("is_from_me") != 1) & value.isNotNull(), F.struct(value.alias("email"), F.lit(None).cast("string").alias("name"))).alias("person"),
    )
    return _days(lines, "sms", "chat", F.lit("private"), 8_000)


class SlackExport(Source):
    """An export folder: users.json and one folder a channel with JSON files of messages."""

    id = "slack"

    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        users = spark.read.option("multiLine", True).schema("id string, is_bot boolean, deleted boolean, profile struct<real_name: string, email: string>").json(f"{self.path}/users.json")
        people = users.where("NOT coalesce(is_bot, false) AND profile.real_name IS NOT NULL").select(F.col("id").alias("user"), F.struct(F.lower("profile.email").alias("email"), F.col("profile.real_name").alias("name")).alias("person"))
        raw = spark.read.option("multiLine", True).schema("type string, subtype string, user string, text string, ts string").json(f"{self.path}/*/*.json")
        raw = raw.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("channel"))
        m = raw.where("subtype IS NULL AND trim(text) <> ''").join(people, "user", "left")
        lines = m.select("channel", F.timestamp_seconds(F.col("ts").cast("double")).cast("timestamp_ntz").alias("at"), F.coalesce("person.name", "user").alias("who"), F.substring("text", 1, 500).alias("line"), "person")
        out = _days(lines, self.id, "channel", F.when(F.startswith("channel", F.lit("dm")), "private").otherwise("personal"), 8_000)
        return out.where(F.col("occurred_end") >= F.lit(since).cast("timestamp_ntz")) if since else out


EVENT_SCHEMA = "type string, created_at string, repo struct<name: string>, payload struct<action: string, ref: string, ref_type: string, size: int, commits: array<struct<message: string>>, pull_request: struct<title: string, number: int, merged: boolean>, issue: struct<title: string, number: int>, release: struct<tag_name: string>>"


def summarize_event() -> Column:
    """A line for a repository event, null for kinds that say nothing."""
    p = F.col("payload")
    commits = F.array_join(F.transform(F.slice(p["commits"], 1, 3), lambda c: F.substring_index(c["message"], "\n", 1)), "; ")
    pull = F.when(p["pull_request"]["merged"], "merged").otherwise(p["action"])
    kind = F.col("type")
    return (
        F.when(kind == "PushEvent", F.concat(F.lit("pushed "), F.coalesce(p["size"], F.size(p["commits"])).cast("string"), F.lit(" commits: "), commits))
        .when((kind == "PullRequestEvent") & ~p["action"].isin("labeled", "unlabeled"), F.concat(pull, F.lit(" pull request #"), p["pull_request"]["number"].cast("string"), F.lit(" "), p["pull_request"]["title"]))
        .when((kind == "IssuesEvent") & ~p["action"].isin("labeled", "unlabeled"), F.concat(p["action"], F.lit(" issue #"), p["issue"]["number"].cast("string"), F.lit(" "), p["issue"]["title"]))
        .when(kind == "IssueCommentEvent", F.concat(F.lit("commented on #"), p["issue"]["number"].cast("string"), F.lit(" "), p["issue"]["title"]))
        .when(kind == "CreateEvent", F.concat(F.lit("created "), p["ref_type"], F.lit(" "), F.coalesce(p["ref"], F.lit(""))))
        .when(kind == "ReleaseEvent", F.concat(F.lit("released "), p["release"]["tag_name"]))
        .when(kind == "ForkEvent", F.lit("forked"))
        .when(kind == "PullRequestReviewEvent", F.concat(F.lit("reviewed #"), p["pull_request"]["number"].cast("string")))
    )


class RepositoryEvents(Source):
    """JSON events, one episode for each repository and day."""

    id = "github"

    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        e = spark.read.schema(EVENT_SCHEMA).json(self.path).withColumn("line", summarize_event()).where("line IS NOT NULL")
        none = F.lit(None).cast("struct<email: string, name: string>")
        lines = e.select(F.col("repo.name").alias("repo"), F.to_timestamp("created_at").cast("timestamp_ntz").alias("at"), F.lit(None).cast("string").alias("who"), "line", none.alias("person"))
        out = _days(lines, self.id, "repo", F.lit("public"), 8_000)
        # A day that was read in part is read again from its start.
        return out.where(F.to_date("occurred_at") >= F.to_date(F.lit(since))) if since else out


def project_root(path: Column) -> Column:
    """The folder of a repository that a path lies in, null where it lies in none."""
    return F.nullif(F.regexp_extract(path, r"/(?:Github|src|repos|code)/([^/]+)", 1), F.lit(""))


def touched_paths(content: Column) -> Column:
    """The absolute paths that tool calls in a message's JSON parts name."""
    parts = F.from_json(content, "array<struct<type: string, input: map<string,string>>>")
    used = F.filter(parts, lambda p: p["type"] == "tool_use")
    values = F.flatten(F.transform(used, lambda p: F.coalesce(F.map_values(F.map_filter(p["input"], lambda k, v: k.isin("file_path", "path", "notebook_path"))), F.array().cast("array<string>"))))
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.startswith(v, F.lit("/")))


def session_tables(session: DataFrame, message: DataFrame) -> DataFrame:
    """Episodes of an agent's database: session(id, title, started_at, ended_at, cwd), message(session_id, role, content, at).

    The body is the title and what the user asked, in order; a session without a question isn't one.
    """
    asked = message.where("role = 'user' AND trim(content) <> ''").groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("asked"), F.max("at").alias("last"))
    s = session.join(asked, "id")
    body = F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.array_join(F.transform("asked", lambda x: x["content"]), "\n\n"))
    return s.select(
        F.lit("agent.session").alias("source"), F.col("id").alias("source_id"), F.substring(body, 1, 8_000).alias("body"), F.col("started_at").alias("occurred_at"), F.coalesce("ended_at", "last").alias("occurred_end"), F.lit("personal").alias("sensitivity"),
        F.lit(None).cast("array<struct<email: string, name: string>>").alias("people"), F.to_json(F.struct(F.array_compact(F.array(project_root(F.col("cwd")))).alias("projects"), F.size("asked").alias("asked"))).alias("meta"),
    ).select(*COLUMNS)


def repository_projects(episode: DataFrame, nodes: DataFrame, alias: DataFrame) -> DataFrame:
    """(episode_id, node_id): the one project that a repository's episode is about, by its full or last name."""
    repo = episode.where("source = 'github'").select("episode_id", F.lower(F.regexp_replace("source_id", "#[^#]*$", "")).alias("full"))
    names = repo.select("episode_id", F.explode(F.array("full", F.substring_index("full", "/", -1))).alias("name"))
    project = nodes.where("node_type = 'project'").select("node_id", F.lower(F.trim("name")).alias("name"))
    known = project.union(alias.join(project.select("node_id"), "node_id", "left_semi").select("node_id", F.col("alias").alias("name"))).distinct()
    hits = names.join(known, "name").groupBy("episode_id").agg(F.min("node_id").alias("node_id"), F.countDistinct("node_id").alias("n"))
    return hits.where("n = 1").select("episode_id", "node_id")


class AgentSessions(Source):
    """JSON lines of coding sessions, one file a session."""

    id = "agent.session"

    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        schema = "type string, timestamp string, cwd string, gitBranch string, message struct<role: string, content: string>"  # a list of parts is read as its JSON
        rows = spark.read.schema(schema).json(self.path).select("*", F.col("_metadata.file_name").alias("file"), F.to_timestamp("timestamp").cast("timestamp_ntz").alias("at"))
        asked = (F.col("type") == "user") & F.col("message.content").isNotNull() & ~F.rlike(F.ltrim("message.content"), F.lit(r"^(<|\[\{)"))
        one = rows.groupBy("file").agg(
            F.min("at").alias("occurred_at"), F.max("at").alias("occurred_end"), F.min_by(F.when(asked, F.col("message.content")), F.when(asked, F.col("at"))).alias("first"), F.count_if(asked).alias("asked"), F.sort_array(F.collect_set("cwd")).alias("cwds"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list(touched_paths(F.col("message.content")))))).alias("paths"),
        )
        repo = F.array_distinct(F.array_compact(F.transform(F.concat("cwds", "paths"), project_root)))
        out = one.where("asked > 0").select(
            F.lit(self.id).alias("source"), F.regexp_replace("file", r"\.jsonl$", "").alias("source_id"), F.substring("first", 1, 2000).alias("body"), "occurred_at", "occurred_end", F.lit("personal").alias("sensitivity"),
            F.lit(None).cast("array<struct<email: string, name: string>>").alias("people"), F.to_json(F.struct(repo.alias("projects"), "asked", F.slice("paths", 1, 50).alias("paths"))).alias("meta"),
        ).select(*COLUMNS)
        return out.where(F.col("occurred_end") >= F.lit(since).cast("timestamp_ntz")) if since else out
