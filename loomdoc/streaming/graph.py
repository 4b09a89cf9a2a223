"""The statute graph kept up by a stream of section edits, with the sections' hashes as keyed state.

The state of a document is the hash of each of its sections. A batch's edits (the greatest version of each section counts; a
null text removes it) become changes: add, replace or remove; a section whose text is as before gives nothing. The changes of a batch are
extracted and stored under its number, written over if the batch runs again, so a restart from the checkpoint neither loses nor repeats any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomdoc.operators import knowledge

CHANGES = "doc long, id long, action string, text string"


def section_changes(edits: DataFrame) -> DataFrame:
    """doc, id, action, text of each section that is not as before. ``edits``: a stream of doc, id, version (long), text."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        latest: dict[int, tuple] = {}
        for part in parts:
            for i, version, text, h in zip(part["id"].tolist(), part["version"].tolist(), part["text"], part["h"].tolist()):
                if i not in latest or version >= latest[i][0]:
                    latest[i] = (version, text, h)
        out = []
        for i, (_, text, h) in sorted(latest.items()):
            if text is None:
                out += [(key[0], i, "remove", None)] if held.pop(i, None) is not None else []
            elif held.get(i) != h:
                out.append((key[0], i, "replace" if i in held else "add", text))
                held[i] = h
        if held:
            state.update((list(held), list(held.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["doc", "id", "action", "text"])

    rows = edits.select("doc", "id", "version", "text", F.xxhash64("text").alias("h"))
    return rows.groupBy("doc").applyInPandasWithState(run, CHANGES, "ids array<long>, hashes array<long>", "update", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class GraphStore:
    """sections, entities and triples by batch, under a folder that the driver and the executors share."""

    spark: SparkSession
    path: str

    def apply(self, changes: DataFrame, batch: int) -> None:
        """The changes of one batch: what they say anew is extracted and written; what it replaces is no longer the latest."""
        rows = changes.persist()
        try:
            entities, triples = knowledge.build_graph(rows.filter("action <> 'remove'"), "doc", "id", "text")
            for name, df in (("entities", entities), ("triples", triples), ("sections", rows.select("doc", "id", (F.col("action") != "remove").alias("alive")))):  # sections last: they make the others count
                df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        finally:
            rows.unpersist()

    def _latest(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/sections")
        last = rows.groupBy("doc", "id").agg(F.max(F.struct("batch", "alive")).alias("_l"))
        return last.filter("_l.alive").select("doc", "id", F.col("_l.batch").alias("batch"))

    def table(self, name: str) -> DataFrame:
        """``entities`` or ``triples`` of the sections as they are now."""
        return self.spark.read.parquet(f"{self.path}/{name}").join(self._latest(), ["doc", "id", "batch"], "left_semi").drop("batch")


def keep_graph(edits: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Takes in the edits that are there now."""
    return section_changes(edits).writeStream.foreachBatch(store.apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
