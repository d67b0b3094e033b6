"""Exact dedup with a heavy-hitter split. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fold_ascii, whole

#: A digest with more than this share of the rows is certain to be among the Misra-Gries candidates, of which there are at most 1 / SUPPORT.
SUPPORT = 1 / 2000


def heavy_candidates(digests: DataFrame, column: str = "digest", support: float = SUPPORT) -> list[str]:
    """Misra-Gries summary of a column (one pass, mergeable, at most 1/support entries): every value with a larger share is in it."""
    row = digests.freqItems([column], support).head()
    return [x for x in (row[0] if row and row[0] else []) if x is not None]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the group), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z (or as `key` says). Null texts count as empty and so equal each other.
    Rows with a null id take part; they are kept only where the whole group has null ids. Repeated rows (same id, same text) all count in
    group_size and share their flag. An empty table gives an empty result. Other columns are ignored, whatever their names.

    Frequent digests: candidates by Misra-Gries, counted exactly (partial sums before the shuffle), and those that win, at most 1/support
    rows, are broadcast, so that their rows never move. The remaining digests each have a small share of the rows and go through an
    ordinary shuffle. What is shuffled are digests and ids, never texts.
    """
    norm = fold_ascii(whole(F.col(text_col))) if key is None else whole(key)
    digests = cut(docs.select(F.col(id_col).alias("id"), F.sha2(norm.cast("binary"), 256).alias("digest")), "digests")
    candidates = heavy_candidates(digests, support=support)
    out = [F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256")]
    if not candidates:
        return _light(digests).select(*out)
    spark = digests.sparkSession
    listed = F.broadcast(spark.createDataFrame([(x,) for x in candidates], "digest string"))
    counted = digests.join(listed, "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Verified winners only: a candidate that occurs once or twice gains nothing from the broadcast.
    winners = F.broadcast(cut(counted.filter("group_size > 2"), "winners"))
    heavy = digests.join(winners, "digest")
    light = _light(digests.join(winners, "digest", "left_anti"))
    return heavy.select(*out).unionByName(light.select(*out))


def _light(digests: DataFrame) -> DataFrame:
    group = Window.partitionBy("digest")
    return digests.withColumns({"keep_id": F.max("id").over(group), "group_size": F.count(F.lit(1)).over(group)})
