"""Catalogue, labels, usage and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import TYPE_ORDER
from ..functions import text as T
from ..functions.order import ahead


def in_window(ts: Column, reference: Column, days: int) -> Column:
    """Within `days` days before the reference time; 0 means always."""
    return F.lit(True) if not days else ts >= reference - F.expr(f"INTERVAL {int(days)} DAYS")


def usage_summary(logs: DataFrame, types: list[str], times: list[str], by: list[str] | None = None) -> DataFrame:
    """Totals, a count per response type, rates in per cent (0.0 without rows) and averages, rounded to two digits (null without values)."""
    kind = F.col("response_type")
    counts = [F.count_if(kind == t).alias(f"n_{t}") for t in types]
    rates = [F.coalesce(F.round(100.0 * F.count_if(kind == t) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2), F.lit(0.0)).alias(f"rate_{t}") for t in types]
    return logs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *counts, *rates, *[F.round(F.avg(c), 2).alias(f"avg_{c}") for c in times])


def recent(logs: DataFrame, n: int) -> DataFrame:
    """The n latest rows. A top-n report."""
    return logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(n)


def latency_table(samples: DataFrame, by: str, value: str, error_value: float = 30_000, marks: tuple[int, ...] = (2000, 3000)) -> DataFrame:
    """Percentiles by nearest rank, the largest, how many lie above marks, and failures (null values count as error_value).

    Equal values are counted first; their places come from ranges of values, so that no group's rows meet in one task."""
    v = samples.select(F.col(by).alias("g"), F.coalesce(value, F.lit(float(error_value))).alias("v"), F.col(value).isNull().alias("bad"))
    counts = v.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"), F.count_if("bad").alias("bad"))
    r = ahead(counts, [F.col("v")], ("g",), "k", "before")
    total = counts.groupBy("g").agg(F.sum("k").alias("n"))
    r = r.withColumnRenamed("g", "own").join(total, F.col("own").eqNullSafe(F.col("g")))

    def at(p: float) -> Column:
        place = F.least(F.round((F.col("n") - 1) * p, 0).cast("long"), F.col("n") - 1)
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("k")), F.col("v")))

    return r.groupBy("g").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("max"), *[F.coalesce(F.sum(F.when(F.col("v") > m, F.col("k"))), F.lit(0)).alias(f"over_{m}") for m in marks], F.sum("bad").alias("errors")).withColumnRenamed("g", by)


def tag_norms(tags: DataFrame) -> DataFrame:
    """(tag_type, norm, share, documents): the most common value set per type, ties to the smaller; its share of the documents that carry the type."""
    sets = tags.groupBy("tag_type", "document_id").agg(F.sort_array(F.collect_set("tag_value")).alias("norm"))
    counts = sets.groupBy("tag_type", "norm").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("tag_type").agg(F.sum("n").alias("documents"), F.min(F.struct((-F.col("n")).alias("n"), "norm")).alias("first"))
    return total.select("tag_type", F.col("first.norm").alias("norm"), (-F.col("first.n") / F.col("documents")).alias("share"), "documents")


def tags_by_document(tags: DataFrame) -> DataFrame:
    """(document_id, tags): {type: sorted values}."""
    sets = tags.groupBy("document_id", "tag_type").agg(F.sort_array(F.collect_set("tag_value")).alias("v"))
    return sets.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag_type", "v")))).alias("tags"))


def labels(tags: DataFrame, mode: str = "deviation", least_share: float = 0.5) -> DataFrame:
    """(document_id, label): the value sets in which a document differs from the norm; all with mode always; null if nothing is shown."""
    sets = tags.groupBy("document_id", "tag_type").agg(F.sort_array(F.collect_set("tag_value")).alias("v"))
    norms = F.broadcast(tag_norms(tags).select("tag_type", "norm", "share"))  # a row for each tag type
    same = F.coalesce((F.col("share") >= least_share) & (F.col("v") == F.col("norm")), F.lit(False))
    shown = {"off": F.lit(False), "always": F.lit(True), "deviation": ~same}[mode]
    order = F.coalesce(*[F.when(F.col("tag_type") == t, i) for i, t in enumerate(TYPE_ORDER)], F.lit(len(TYPE_ORDER)))
    rows = sets.join(norms, "tag_type", "left").select("document_id", F.when(shown, F.struct(order.alias("o"), "tag_type", F.array_join("v", ", ").alias("t"))).alias("x"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("document_id", F.nullif(F.array_join(F.transform("x", lambda s: s["t"]), "; "), F.lit("")).alias("label"))


def document_list(documents: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents with the number of their chunks, superseded ones too, and their tags as sorted 'type: value' texts."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    t = tags.groupBy("document_id").agg(F.sort_array(F.collect_set(F.concat_ws(": ", "tag_type", "tag_value"))).alias("tags"))
    return documents.join(n, "document_id", "left").join(t, "document_id", "left").withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def policies(documents: DataFrame) -> DataFrame:
    """Title (or source file), last change, by title; active and unrestricted ones."""
    open_ = documents.filter((F.col("status") == "active") & ~F.col("is_restricted"))
    return open_.select("document_id", F.coalesce(F.nullif("document_title", F.lit("")), "source_file").alias("title"), F.coalesce("updated_at", "created_at").alias("changed_at")).orderBy("title", "document_id")


def catalog(documents: DataFrame) -> DataFrame:
    """(position, title): titles of active, unrestricted documents, one per normalised title (the first source file's), in its order:
    places come from ranges of titles."""
    t = documents.filter((F.col("status") == "active") & ~F.col("is_restricted") & F.col("document_title").isNotNull()).withColumn("key", T.normalise_title(F.col("document_title"))).filter("key <> ''")
    first = t.groupBy("key").agg(F.min_by(F.trim("document_title"), F.struct(F.lower("document_title"), "source_file")).alias("title"))
    return ahead(first, [F.col("key")], name="position").select((F.col("position") + 1).cast("int").alias("position"), "title")


def topics(documents: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct topic names of active, unrestricted titles."""
    t = documents.filter((F.col("status") == "active") & ~F.col("is_restricted") & F.col("document_title").isNotNull())
    return t.select(T.topic_title(F.col("document_title"), prefix).alias("topic")).filter("topic <> ''").distinct()


def sample_topics(names: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n topics, drawn by seed. A sampling operator."""
    return names.orderBy(F.xxhash64(F.lit(seed), "topic"), "topic").limit(n)


def missing_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Current chunks without a vector."""
    return chunks.filter(~F.col("is_superseded")).join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def duplicate_embeddings(vectors: DataFrame) -> DataFrame:
    """(duplicated): how many (chunk, model) have more than one vector."""
    return vectors.groupBy("chunk_id", "model_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("duplicated"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def opening_window(chunks: DataFrame, tokens: int = 800) -> DataFrame:
    """The chunks of each document that open it: in order until their tokens reach a bound, the one that crosses it included; null counts as 0."""
    before = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("before", F.coalesce(F.sum(F.coalesce("token_count", F.lit(0))).over(before), F.lit(0))).filter(F.col("before") < tokens)


def extract_tags(opening: DataFrame, model, values: tuple[str, ...] = ("tag_type", "tag_value")) -> DataFrame:
    """(document_id, tag_type, tag_value) that `model`, a function from a text column to array<struct<tag_type, tag_value>>, finds in openings."""
    text = opening.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("opening"))
    return text.select("document_id", F.explode(model(F.col("opening"))).alias("t")).select("document_id", *[F.col(f"t.{v}").alias(v) for v in values]).distinct()


def catalog_reply(titles: DataFrame, shown: int = 12) -> DataFrame:
    """One row: how many titles there are, and a sentence with the first `shown`, 'and k more' behind."""
    rows = titles.groupBy().agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("position") <= shown, F.struct("position", "title")))).alias("t"))
    names = F.transform("t", lambda x: T.display_title(x["title"]))
    more = F.concat(F.array_join(names, ", "), F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))
    return rows.select("n", F.when(F.col("n") == 0, "There are no documents loaded yet.").otherwise(F.concat(F.lit("I can answer questions from "), F.col("n").cast("string"), F.lit(" documents: "), F.when(F.col("n") > shown, more).otherwise(T.join_words(names)), F.lit(". Just ask me about any of them."))).alias("reply"))
