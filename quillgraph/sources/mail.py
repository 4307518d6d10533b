"""Mailboxes: messages are parsed in Arrow batches, grouped into threads with DataFrame operators."""

from __future__ import annotations

import email
import email.policy
from datetime import UTC
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalize_subject
from .base import COLUMNS, Source, pieces

MESSAGE = "id string, parent string, subject string, at timestamp_ntz, people array<struct<email: string, name: string>>, text string, bulk boolean"


def split_mbox(text: Column) -> Column:
    """Raw messages: each begins at a line that starts with "From "."""
    return F.filter(F.split(text, r"(?m)^(?=From )"), lambda m: F.startswith(m, F.lit("From ")))


def _addresses(message, *names: str) -> list[dict]:
    found = getaddresses([v for n in names for v in message.get_all(n, [])])
    return [{"email": a.strip().lower(), "name": n.strip() or None} for n, a in found if "@" in a]


def _body(message) -> str:
    for part in message.walk():
        if part.get_content_type() == "text/plain":
            payload = part.get_payload(decode=True) or b""
            return payload.decode(part.get_content_charset() or "utf-8", "replace")
    return ""


def parse(raw: str) -> dict:
    message = email.message_from_string(raw.split("\n", 1)[1] if "\n" in raw else "", policy=email.policy.compat32)
    references = (message.get("References") or "").split()
    parent = references[0] if references else (message.get("In-Reply-To") or "").strip() or None
    at = None
    try:
        stamp = parsedate_to_datetime(message.get("Date"))
        at = stamp.astimezone(UTC).replace(tzinfo=None) if stamp.tzinfo else stamp
    except (TypeError, ValueError):
        pass
    bulk = bool(message.get("List-Unsubscribe") or message.get("List-Id") or (message.get("Precedence") or "").strip().lower() == "bulk")
    return {
        "id": (message.get("Message-ID") or "").strip() or None, "parent": parent, "subject": message.get("Subject") or "", "at": at,
        "people": _addresses(message, "From", "To", "Cc"), "text": _body(message), "bulk": bulk,
    }


def _messages(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(r or "") for r in raw], columns=[c.split()[0] for c in ("id", "parent", "subject", "at", "people", "text", "bulk")])


def parse_message(raw: Column) -> Column:
    return F.pandas_udf(_messages, MESSAGE)(raw)


def without_quotes(text: Column) -> Column:
    """The lines before the first that quotes or introduces a quotation."""
    lines = F.split(F.regexp_replace(text, "\r", ""), "\n")
    quoted = F.array_position(F.transform(lines, lambda x: F.startswith(F.ltrim(x), F.lit(">")) | F.startswith(x, F.lit("On "))), True)
    kept = F.when(quoted > 0, F.slice(lines, F.lit(1), (quoted - 1).cast("int"))).otherwise(lines)
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


class Mbox(Source):
    """One episode a thread; `owner` is no contact; bulk mail is left out."""

    id = "email"

    def __init__(self, path: str, owner: str = ""):
        super().__init__(path)
        self.owner = owner.lower()

    def messages(self, spark: SparkSession) -> DataFrame:
        # A message begins at a line that starts with "From "; the file's first one still has it.
        text = F.when(F.startswith("value", F.lit("From ")), F.col("value")).otherwise(F.concat(F.lit("From "), "value"))
        raw = pieces(spark, self.path, "\nFrom ").select(text.alias("raw"))
        m = raw.select(parse_message(F.col("raw")).alias("m")).select("m.*").where("NOT bulk")
        root = F.coalesce("parent", "id", F.concat(F.lit("subject:"), normalize_subject(F.col("subject"))))
        return m.withColumn("root", root)

    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        part = F.struct("at", "id", "subject", F.substring(without_quotes(F.col("text")), 1, 1500).alias("text"))
        threads = self.messages(spark).groupBy("root").agg(
            F.sort_array(F.collect_list(part)).alias("parts"), F.min("at").alias("occurred_at"), F.max("at").alias("occurred_end"),
            F.array_distinct(F.flatten(F.collect_list("people"))).alias("people"),
        )
        subject = F.element_at("parts", 1)["subject"]
        body = F.concat_ws("\n\n", F.array(subject), F.transform("parts", lambda p: p["text"]))
        out = threads.select(
            F.lit("email").alias("source"), F.col("root").alias("source_id"), F.substring(body, 1, 10_000).alias("body"), "occurred_at", "occurred_end", F.lit("personal").alias("sensitivity"),
            F.filter("people", lambda p: p["email"] != self.owner).alias("people"), F.to_json(F.struct(F.size("parts").alias("messages"), subject.alias("subject"))).alias("meta"),
        ).select(*COLUMNS)
        return out.where(F.col("occurred_end") >= F.lit(since).cast("timestamp_ntz")) if since else out
