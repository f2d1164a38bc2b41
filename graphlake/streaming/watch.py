"""Watching a folder: changed files are extracted once, then everything relational is rebuilt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphlake.sources.code import extract_code


def watch(spark: SparkSession, folder: str, facts_path: str, checkpoint: str, rebuild: Callable[[DataFrame], None] | None = None, once: bool = False) -> StreamingQuery:
    """Micro-batches over the text files of ``folder``: the facts of new files go to ``facts_path``, by batch.

    Each batch overwrites its own partition, so a repeated batch leaves the same facts. ``rebuild`` gets all
    facts after each batch. With ``once`` the query ends when the files at hand are done.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    files = files.selectExpr("value AS content", "_metadata.file_path AS path")

    def step(batch: DataFrame, number: int) -> None:
        extract_code(batch).write.mode("overwrite").parquet(f"{facts_path}/batch={number}")
        if rebuild is not None:
            rebuild(batch.sparkSession.read.parquet(facts_path))

    out = files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.trigger(processingTime="3 seconds").start()
