"""The versioned store: snapshots in which a key has one active row. Nothing is changed in place; each function returns the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def document_id(source_file, fingerprint, version):
    """A deterministic id, so that a task that runs again gives the same."""
    return F.substring(F.sha2(F.concat_ws("\x1f", source_file, fingerprint, version.cast("string")).cast("binary"), 256), 1, 32)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last by order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chunk_set(chunks: DataFrame, by: str) -> DataFrame:
    """(by, prints): the set of (chunk_id, content_hash)."""
    return chunks.groupBy(by).agg(F.sort_array(F.collect_set(F.struct("chunk_id", "content_hash"))).alias("prints"))


def load_actions(new: DataFrame, active: DataFrame) -> DataFrame:
    """(source_file, action): inserted, unchanged or superseded, by comparing chunk sets; absent for active files that aren't in the batch.

    Both: source_file, chunk_id, content_hash."""
    a, b = chunk_set(new, "source_file").withColumnRenamed("prints", "n"), chunk_set(active, "source_file").withColumnRenamed("prints", "o")
    action = F.when(F.col("n").isNull(), "absent").when(F.col("o").isNull(), "inserted").when(F.col("n") == F.col("o"), "unchanged").otherwise("superseded")
    return a.join(b, "source_file", "full_outer").select("source_file", action.alias("action"))


def supersede(documents: DataFrame, incoming: DataFrame, actions: DataFrame) -> DataFrame:
    """documents (source_file, version, status, ...) after a load: replaced versions superseded, new ones active with the next version."""
    replaced = actions.filter("action = 'superseded'").select("source_file", F.lit(True).alias("gone"))
    old = documents.join(replaced, "source_file", "left").withColumn("status", F.when((F.col("status") == "active") & F.col("gone"), "superseded").otherwise(F.col("status"))).drop("gone")
    last = documents.groupBy("source_file").agg(F.max("version").alias("last"))
    fresh = incoming.join(actions.filter("action IN ('inserted', 'superseded')").select("source_file"), "source_file", "left_semi").join(last, "source_file", "left")
    fresh = fresh.withColumns({"version": F.coalesce("last", F.lit(0)) + 1, "status": F.lit("active")}).drop("last")
    return old.unionByName(fresh, allowMissingColumns=True)


def set_status(documents: DataFrame, chunks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, refused) after changes (document_id, status): a document and all its chunks change together; refused are those that would make a
    second active version of a source file."""
    asked = changes.select("document_id", F.col("status").alias("wanted"))
    rows = documents.join(asked, "document_id", "left").withColumn("next", F.coalesce("wanted", "status"))
    count = Window.partitionBy("source_file")
    rows = rows.withColumn("bad", (F.count_if(F.col("next") == "active").over(count) > 1) & (F.col("wanted") == "active") & (F.col("status") != "active"))
    rows = rows.withColumn("next", F.when(F.coalesce("bad", F.lit(False)), F.col("status")).otherwise(F.col("next")))
    state = rows.select("document_id", F.col("next").alias("now"))
    changed = chunks.join(state, "document_id", "left").withColumn("is_superseded", F.coalesce(F.col("now") == "superseded", F.col("is_superseded"))).drop("now")
    return rows.withColumn("status", F.col("next")).drop("wanted", "next", "bad"), changed, rows.filter("bad").select("document_id")


def restrict(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents with is_restricted as changes (document_id, is_restricted) say."""
    c = changes.select("document_id", F.col("is_restricted").alias("wanted"))
    return documents.join(c, "document_id", "left").withColumn("is_restricted", F.coalesce("wanted", "is_restricted")).drop("wanted")


def retitle(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents with new titles: one line of 1 to 200 characters; others are ignored."""
    t = F.trim("title")
    c = changes.select("document_id", t.alias("wanted")).filter(F.char_length("wanted").between(1, 200) & ~F.col("wanted").rlike(r"[\r\n]"))
    return documents.join(c, "document_id", "left").withColumn("document_title", F.coalesce("wanted", "document_title")).drop("wanted")


def add_tags(bridge: DataFrame, found: DataFrame, skip: tuple[str, ...] = ("raw",)) -> DataFrame:
    """bridge (document_id, tag_type, tag_value) with those of found that it lacks; found: document_id, tags map<string,array<string>>."""
    rows = found.select("document_id", F.explode("tags").alias("tag_type", "v")).filter(~F.col("tag_type").isin(*skip)).select("document_id", "tag_type", F.explode("v").alias("tag_value")).distinct()
    keys = ["document_id", "tag_type", "tag_value"]
    return bridge.select(*keys).unionByName(rows.join(bridge, keys, "left_anti"))


def next_versions(prompts: DataFrame) -> DataFrame:
    """(name, channel, active_version, versions, next_version)."""
    return prompts.groupBy("name", "channel").agg(F.max(F.when(F.col("is_active"), F.col("version"))).alias("active_version"), F.count(F.lit(1)).alias("versions"), (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def add_prompts(prompts: DataFrame, new: DataFrame) -> DataFrame:
    """prompts with new ones (name, channel, content) as the active versions of their slots; earlier rows stay, no longer active."""
    slots = new.select("name", "channel").distinct().withColumn("touched", F.lit(True))
    last = prompts.groupBy("name", "channel").agg(F.max("version").alias("last"))
    order = Window.partitionBy("name", "channel").orderBy("content")
    fresh = new.join(last, ["name", "channel"], "left").withColumn("version", F.coalesce("last", F.lit(0)) + F.row_number().over(order)).drop("last")
    fresh = fresh.withColumn("is_active", F.col("version") == F.max("version").over(Window.partitionBy("name", "channel")))
    old = prompts.join(slots, ["name", "channel"], "left").withColumn("is_active", F.col("is_active") & F.col("touched").isNull()).drop("touched")
    return old.unionByName(fresh, allowMissingColumns=True)


def activate(rows: DataFrame, slot: list[str], chosen: DataFrame) -> DataFrame:
    """rows with exactly the chosen (slot..., version) active in their slots; choices that name no row change nothing."""
    good = chosen.join(rows, [*slot, "version"], "left_semi").select(*slot, F.col("version").alias("wanted"))
    return rows.join(good, slot, "left").withColumn("is_active", F.when(F.col("wanted").isNull(), F.col("is_active")).otherwise(F.col("version") == F.col("wanted"))).drop("wanted")


def resolve(config: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """(key, value): of config (key, value), that of key.channel if there, else that of key."""
    spark = config.sparkSession
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    own = config.select(F.regexp_replace("key", rf"\.{channel}$", "").alias("key"), F.col("value").alias("own")).where(config["key"].endswith(f".{channel}"))
    return asked.join(own, "key", "left").join(config.select("key", "value"), "key", "left").select("key", F.coalesce("own", "value").alias("value"))
