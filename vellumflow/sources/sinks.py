"""Writers: append-only score logs, partitioned run output, error tables in a fixed order, text files by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_scores(scores: DataFrame, path: str) -> None:
    """Append to a parquet log; numbers stay numbers, so no later reader has to repair lines."""
    scores.write.mode("append").parquet(path)


def write_run(mentions: DataFrame, path: str, by: tuple[str, ...] = ("model", "temperature", "mode", "language")) -> None:
    """Output of runs, partitioned by configuration; only the partitions written are replaced."""
    mentions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_errors(instances: DataFrame, path: str) -> None:
    """Error instances as csv: by page, misses before false alarms before hits, then by start."""
    kind = F.when(F.col("type") == "FN", 0).when(F.col("type") == "FP", 1).otherwise(2)
    instances.orderBy("page", kind, F.coalesce("gold_start", "pred_start")).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_texts(texts: DataFrame, path: str, column: str, by: str) -> None:
    """One text column, partitioned by a key: editions, Turtle blocks, repaired paragraphs."""
    texts.select(by, column).write.mode("overwrite").partitionBy(by).text(path)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two versions of a table; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
