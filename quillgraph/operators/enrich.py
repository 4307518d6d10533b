"""Work that a model does: extraction, embedding, summaries.  The model is a function that the
caller passes; it runs on Arrow batches on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn

CLAIM = "episode_id bigint, kind string, subject string, predicate string, object string, statement string, confidence double, error string"


def extract(episode: DataFrame, done: DataFrame, version: str, model: Callable[[list[str]], list[list[dict]]], k: int) -> DataFrame:
    """Claims of the newest k episodes that this version hasn't read; a text on which the model
    fails gives one row with the error, so that it isn't tried for ever."""
    fresh = episode.join(done.where(F.col("version") == version).select("episode_id"), "episode_id", "left_anti")
    some = fresh.orderBy(F.desc("occurred_at"), F.desc("episode_id")).limit(k).select("episode_id", "body")
    names = [c.split()[0] for c in CLAIM.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for episode_id, body in zip(batch["episode_id"], batch["body"], strict=True):
                try:
                    rows += [{"episode_id": episode_id, "error": None, **{c: claim.get(c) for c in names[1:-1]}} for claim in model([body])[0]]
                except Exception as e:  # noqa: BLE001 - whatever the model raises is recorded
                    rows.append({"episode_id": episode_id, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return some.mapInPandas(run, CLAIM)


#: What a model is asked for: claims as JSON, of known kinds, each with the words that it rests on.
EXTRACTION_SCHEMA = {
    "type": "object",
    "required": ["claims"],
    "properties": {
        "claims": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["kind", "subject", "predicate", "statement", "confidence"],
                "properties": {
                    "kind": {"enum": ["fact", "commitment"]}, "subject": {"type": "string"}, "predicate": {"type": "string"}, "object": {"type": ["string", "null"]},
                    "statement": {"type": "string"}, "confidence": {"type": "number", "minimum": 0, "maximum": 1},
                },
            },
        }
    },
}


def system_prompt(predicates: list[str]) -> str:
    """Instructions for a model that reads one episode."""
    return (
        "Read the text and list the lasting facts and the promises that it states. Use only what it says. Name people as it does. "
        f"Prefer these predicates: {', '.join(sorted(predicates))}. Leave out small talk and what was merely mentioned. Answer with JSON of the given schema."
    )


def reextract(episode: DataFrame, episode_id: int, model: Callable[[list[str]], list[list[dict]]]) -> DataFrame:
    """Claims of one episode, whatever has been read before."""
    one = episode.where(F.col("episode_id") == episode_id)
    return extract(one, one.where("false").select("episode_id", F.lit("").alias("version")), "", model, 1)


def hash_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder for tests: signed word hashes, of length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % width] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def embed_pending(table: DataFrame, done: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, embedding, error) of rows without one, each text whole.

    A batch that the model refuses is halved, down to single texts; a text that it refuses by itself has
    no embedding and the model's error, so that nothing is embedded but in part.
    """

    def safely(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None) for v in model(texts)]
        except ValueError as e:
            if len(texts) > 1:
                mid = len(texts) // 2
                return safely(texts[:mid]) + safely(texts[mid:])
            return [(None, str(e) or type(e).__name__)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = safely(batch[text].fillna("").tolist()) if len(batch) else []
            yield pd.DataFrame({key: batch[key], "embedding": pd.Series([v for v, _ in found], batch.index, object), "error": pd.Series([e for _, e in found], batch.index, object)})

    kind = table.schema[key].dataType.simpleString()
    return table.join(done.select(key), key, "left_anti").select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>, error string")


def summary_evidence(stale: DataFrame, mention: DataFrame, episode: DataFrame, fact: DataFrame, facts_each: int = 15, snippets_each: int = 8) -> DataFrame:
    """(node_id, evidence): the best facts and the newest snippets of each node, only what may be shown."""
    live = fact.where(fn.is_live() & F.col("sensitivity").isin(*fn.SHOWN)).select(F.col("subject_id").alias("node_id"), "statement", "confidence", "fact_id")
    w = Window.partitionBy("node_id")
    best = live.withColumn("r", F.row_number().over(w.orderBy(F.desc("confidence"), "fact_id"))).where(F.col("r") <= facts_each).groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "statement"))), lambda s: s["statement"]).alias("facts"))
    seen = mention.select("episode_id", "node_id").distinct().join(episode.where(F.col("sensitivity").isin(*fn.SHOWN)), "episode_id")
    newest = seen.withColumn("r", F.row_number().over(w.orderBy(F.desc("occurred_at"), F.desc("episode_id")))).where(F.col("r") <= snippets_each)
    snippets = newest.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.substring("body", 1, 400).alias("text")))), lambda s: s["text"]).alias("snippets"))
    both = stale.select("node_id").join(best, "node_id", "left").join(snippets, "node_id", "left")
    return both.select("node_id", F.concat_ws("\n", F.concat_ws("\n", "facts"), F.concat_ws("\n", "snippets")).alias("evidence")).where("evidence <> ''")


def summarize(evidence: DataFrame, model: Callable[[str], str]) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node_id": batch["node_id"], "summary": [model(e) for e in batch["evidence"]]}, dtype=object)

    return evidence.mapInPandas(run, "node_id string, summary string")
