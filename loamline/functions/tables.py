"""Table functions for SQL: ``parse_document(key, content)`` and ``chunk_text(heading, text)``, each with LATERAL over a table's rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.parsers import ParseError, parse
from .chunking import chunk_sections


@udtf(returnType="ordinal int, title string, heading string, text string, error string")
class ParseDocument:
    """A row for each section of a document. What can't be parsed is one row that holds the error alone; null content has no rows."""

    def eval(self, key: str, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            title, found = parse(key or "", bytes(content))
        except ParseError as e:
            yield None, None, None, None, str(e)
            return
        for n, s in enumerate(found):
            yield n, title, s["heading"], s["text"], None


@udtf(returnType="ordinal int, heading string, text string")
class ChunkText:
    """Chunks of one section, numbered from 0; null text is empty."""

    def eval(self, heading: str, text: str) -> Iterator[tuple]:
        for c in chunk_sections([{"heading": heading, "text": text}]):
            yield c["ordinal"], c["heading"], c["text"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_document", ParseDocument)
    spark.udtf.register("chunk_text", ChunkText)
