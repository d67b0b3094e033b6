"""Structured Streaming forms: uploads loaded batch by batch, usage by day, follow-up context per conversation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store


def uploads(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def load_into(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps snapshots of documents: each batch supersedes what changed and writes snapshot=<batch>, so a batch that runs again
    overwrites only its own. Rows: source_file, chunk_id, content_hash."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _snapshot(spark, folder, number)
        incoming = batch.select("source_file").distinct()
        if old is None:
            rows = batch.select("source_file", "chunk_id", "content_hash", F.lit(1).alias("version"), F.lit("active").alias("status")).distinct()
        else:
            actions = store.load_actions(batch, old.filter("status = 'active'"))
            documents = store.supersede(old.select("source_file", "version", "status").distinct(), incoming, actions)
            kept = old.drop("status").join(documents, ["source_file", "version"])
            fresh = batch.select("source_file", "chunk_id", "content_hash").distinct().join(documents.join(old.select("source_file", "version").distinct(), ["source_file", "version"], "left_anti"), "source_file")
            rows = kept.unionByName(fresh)
        rows.write.mode("overwrite").parquet(f"{folder}/snapshot={number:09d}")

    return run


def _snapshot(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The last snapshot before a batch, or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    names = [n for n in names if n.startswith("snapshot=") and n < f"snapshot={before:09d}"]
    return spark.read.parquet(f"{folder}/{names[-1]}") if names else None


def usage_by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, response_type, n, avg_value) by event time; works on a stream, where a day closes `late` after it, and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "response_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("avg_value")).select(F.col("w.start").alias("day"), "response_type", "n", "avg_value")


def followup_context(turns: DataFrame, prior: int = 2) -> DataFrame:
    """(conv_id, turn, text, query): user turns with the last user messages in front, from state kept per conversation: `prior` texts each."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        said = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, text in zip(rows["turn"], rows["text"], strict=True):
            out.append((key[0], turn, text, " ".join([*said, text])))
            said = [*said, text][-prior:]
        state.update((said,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "query"])

    users = turns.filter("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", "text")
    return users.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turn long, text string, query string", "said array<string>", "append", "NoTimeout")
