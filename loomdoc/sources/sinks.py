"""Writers: rows appended, a partition replaced, and a CSV export for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.mutations import with_total


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to a Parquet table; ``by`` are its partition columns."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def export_csv(df: DataFrame, path: str, label: str | None = None) -> None:
    """CSV with a header; with ``label``, a column, a last row with TOTAL in it and the sums of the numeric columns. The files follow Spark's partitions."""
    out = with_total(df, label) if label else df
    out.write.mode("overwrite").option("header", True).csv(path)


def append_traces(traces: DataFrame, path: str, most: int = 2_000) -> None:
    """Append one wide row per run, with texts cut to ``most`` characters and partitioned by day."""
    texts = [c for c, kind in traces.dtypes if kind == "string"]
    cut_ = traces.withColumns({c: F.left(F.col(c), F.lit(most)) for c in texts})
    append(cut_.withColumn("day", F.to_date("created_at")), path, ["day"])
