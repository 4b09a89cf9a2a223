"""Table functions for SQL: ``FROM documents d, LATERAL chunk(d.text, 'sentence')`` and ``LATERAL extract_entities(s.text, s.title)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomdoc.functions.chunks import STRATEGIES, sentence
from loomdoc.operators.knowledge import entities_of


class Chunk:
    """n, chunk: the pieces of a text by a strategy's name; an unknown one is ``sentence``. Null and empty texts have none."""

    def eval(self, text: str, strategy: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(STRATEGIES.get(strategy, sentence)(text) if text else [])


class ExtractEntities:
    """n, name, type, place: the entities of a text; the second argument is its own law, or null."""

    def eval(self, text: str, title: str) -> Iterator[tuple[int, str, str, int]]:
        for n, (name, kind, place) in enumerate(entities_of(text, title) if text else []):
            yield n, name, kind, place


def register(spark: SparkSession) -> None:
    """Makes ``chunk`` and ``extract_entities`` known to the session's SQL."""
    spark.udtf.register("chunk", udtf(Chunk, returnType="n int, chunk string"))
    spark.udtf.register("extract_entities", udtf(ExtractEntities, returnType="n int, name string, type string, place int"))
