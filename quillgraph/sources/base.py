"""What a source yields, and how to add one."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

#: Columns of every source's episodes; `people` are contacts to link, `meta` is JSON.
EPISODE = "source string, source_id string, body string, occurred_at timestamp_ntz, occurred_end timestamp_ntz, sensitivity string, people array<struct<email: string, name: string>>, meta string"
COLUMNS = [c.split()[0] for c in EPISODE.replace("array<struct<email: string, name: string>>", "x").split(", ")]


class Source(ABC):
    """A folder or file that becomes episodes."""

    id: str

    def __init__(self, path: str):
        self.path = path

    @abstractmethod
    def fetch(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        """Episodes with the columns of EPISODE, those before `since` left out."""


def pieces(spark: SparkSession, path: str, before: str) -> DataFrame:
    """(value): the text after each `before` and before the next; a file is cut by several tasks, whatever its size."""
    return spark.read.text(path, lineSep=before)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one row."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS path", "value")
