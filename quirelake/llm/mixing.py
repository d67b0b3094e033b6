"""Mixing sources to target weights. DataFrame functions only.

Each source's words are a stream, its documents in a pseudorandom order; the stream is packed into blocks of BLOCK words. The mix is a row of
slots, dealt out to shards of SHARD slots. Which source fills which slot of which shard is a multinomial draw given the sources' totals: the slots
are numbered by source and carried to places by a pseudorandom permutation, so each shard's counts are what multinomial draws give once their
sums are held to the targets. A source's k-th slot takes the block that its own permutation gives for k; blocks are joined by that index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, cut_small, let, whole

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK, SHARD = 128, 4096
#: Parts of each source whose running sums are made side by side.
PARTS = 512
ROUNDS = 8
#: Steps (of SHARD slots) that a task lays out, and the most tasks for it.
STEPS, TASKS = 32, 20_000
_P = 2147483647  # a prime; products of two values below it fit a long


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: ROUNDS of swap-or-not, each of which swaps x with k - x (mod n) or leaves both."""
    at = x
    for r in range(ROUNDS):

        def step(v: Column, r: int = r) -> Column:
            k = F.pmod(F.xxhash64(key, F.lit(2 * r)), n)
            other = F.pmod(k - v, n)
            bit = F.pmod(F.xxhash64(key, F.lit(2 * r + 1), F.greatest(v, other)), F.lit(2))
            return F.when(bit == 1, other).otherwise(v)

        at = let(at, step)
    return at


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, size) with the sources by code point, null last: rank, weight and target, the words to take.

    Targets are by weight and never above most * size; what is cut off goes to the others by weight, until none is above. In closed form:
    sources in order of most * size / weight; those are held whose bound lies below the level that the rest would have. Sources without words
    have target 0. This is a table of a row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    held = ranked.withColumn("bound", F.lit(float(most)) * F.col("size"))
    before = Window.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    held = held.withColumns({"left": left, "rest": rest}).withColumn("full", F.col("bound") * F.col("rest") <= F.col("weight") * F.col("left"))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = (F.lit(float(share)) * F.sum("size").over(every) - F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0.0)).over(every)) / free
    return held.withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * level)).select("source", "rank", "weight", "size", "target")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix, all tables in the shared folder.

    documents: id, uid, source, size, source_size, target. pieces: uid, source rank, block, from, to (the document's words, counted from 0, that
    the block holds) and at (their place in the block). slots: shard, place, rank, k, pass, block, words (what the slot takes of its block).
    Null texts have size 0, a null source is a source of its own, placed last. Repeated rows are documents of their own. Reruns agree: the
    order within a source is by a hash of id and text. An empty table gives empty ones. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(whole(F.col(text_col)), F.lit(WORD)).cast("long").alias("size"), *[c.alias(k) for k, c in _keys(seed, id_col, text_col).items()])
    base = cut(base, "sizes")
    sizes = cut_small(targets(base.groupBy("source").agg(F.sum("size").alias("size")), share, most, weights), "targets")
    on_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    small = sizes.withColumnRenamed("size", "source_size")  # a row for each source
    named = base.join(small, on_source(base, small)).select("id", base["source"], "size", "_k1", "_k2", "rank", "source_size", "target")
    # Running sums in two levels, so that no source's documents meet in one task.
    part = named.withColumn("part", F.pmod("_k1", F.lit(PARTS)).cast("int"))
    ahead = part.groupBy("rank", "part").agg(F.sum("size").alias("n"))
    ahead = cut_small(ahead.select("rank", "part", (F.sum("n").over(Window.partitionBy("rank").orderBy("part")) - F.col("n")).alias("ahead")), "ahead")
    order = Window.partitionBy("rank", "part").orderBy("_k1", "_k2")
    placed = part.join(ahead, ["rank", "part"]).withColumns({"start": F.col("ahead") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(order)})
    placed = cut(placed.select("id", F.struct("rank", "part", "nth").alias("uid"), "source", "size", "source_size", "target", "rank", "start", "_k1", "_k2"), "placed")
    end = F.col("start") + F.col("size")
    first = lambda b: F.greatest(F.col("start"), b * block)
    span = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = placed.filter("size > 0").select("uid", "rank", "start", "size", F.explode(span).alias("block"))
    pieces = pieces.select("uid", "rank", "block", (first(F.col("block")) - F.col("start")).alias("from"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")).alias("to"), (first(F.col("block")) - F.col("block") * block).alias("at"))
    # Slots: whole passes over a source, then part of one, whose last slot is shortened to the target.
    plan = sizes.filter("size > 0 AND target > 0").select("rank", F.col("size").alias("words"), F.ceil(F.col("size") / block).alias("blocks"), F.least(F.round("target").cast("long"), (F.lit(most) * F.col("size")).cast("long")).alias("take"))
    plan = plan.withColumns({"passes": F.floor(F.col("take") / F.col("words")), "over": F.col("take") % F.col("words")})
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block))
    plan = plan.withColumns({"base": F.sum("slots").over(Window.orderBy("rank")) - F.col("slots"), "all": F.sum("slots").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    steps = plan.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / shard))).alias("step"))
    # A row of steps becomes `shard` rows, so their number of tasks is stated: by bytes they would be coalesced into one.
    n = plan.agg(F.sum(F.ceil(F.col("slots") / shard))).first()[0] or 1
    steps = steps.repartition(int(min(-(-n // STEPS), TASKS)), "rank", "step")
    slots = steps.select("*", F.explode(F.sequence(F.col("step") * shard, F.least((F.col("step") + 1) * shard, F.col("slots")) - 1)).alias("k"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    place = permuted(F.col("base") + F.col("k"), F.col("all"), F.lit(seed))
    chosen = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed + 1), "rank", turn))
    last = (F.col("k") == F.col("slots") - 1) & (F.col("over") % block > 0)
    slots = slots.select("rank", "k", turn.alias("pass"), place.alias("place"), chosen.alias("block"), F.when(last, F.col("over") % block).otherwise(F.lit(block)).cast("int").alias("words"))
    return placed, cut(pieces, "pieces"), cut(slots.withColumn("shard", F.floor(F.col("place") / shard)), "slots")


def taken_ranges(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """(uid, pass, shard, place, from, to): the words of documents that the slots take; blocks joined by index."""
    joined = pieces.join(slots, ["rank", "block"])
    return joined.withColumn("to", F.least(F.col("to"), F.col("from") + F.col("words") - F.col("at"))).filter(F.col("to") > F.col("from")).select("uid", "pass", "shard", "place", "from", "to")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's), taken (words the mix takes of it, repeats counted). See mix_plan."""
    placed, pieces, slots = mix_plan(docs, id_col, **options)
    taken = taken_ranges(pieces, slots).groupBy("uid").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return placed.join(taken, "uid", "left").select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, rank, slots): the multinomial draw of each output shard."""
    return slots.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("slots"))


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mix as documents, columns as in docs: a row for each pass over a document that takes words of it. Where a pass takes the whole
    document, its text is unchanged; else it holds the taken words, single-spaced, in their order. n_chars, if there, follows the text."""
    placed, pieces, slots = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    got = taken_ranges(pieces, slots).groupBy("uid", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"), F.sum(F.col("to") - F.col("from")).alias("taken"))
    got = got.join(placed.select("uid", "_k1", "_k2", "size"), "uid").select("_k1", "_k2", F.when(F.col("taken") < F.col("size"), F.col("ranges")).alias("ranges"))
    # Rows with equal ids and texts stand for one another, so each row of the mix may take its text from any of them. The row's own columns travel as one.
    rows = docs.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in _keys(seed, id_col, text_col).items()]).dropDuplicates(["_k1", "_k2"]).join(got, ["_k1", "_k2"])
    own = F.col("doc").getField(text_col)
    words = let(F.regexp_extract_all(whole(own), F.lit(WORD), F.lit(0)), lambda w: F.flatten(F.transform("ranges", lambda r: F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))))
    rows = rows.select("doc", F.when(F.col("ranges").isNull(), own).otherwise(F.array_join(words, " ")).alias("text"))
    new = {text_col: F.col("text"), "n_chars": F.char_length("text")}
    return rows.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("doc").getField(f.name).alias(f.name) for f in docs.schema])


def _keys(seed: int, id_col: str, text_col: str) -> dict[str, Column]:
    return {"_k1": F.xxhash64(F.lit(seed), id_col, text_col), "_k2": F.xxhash64(F.lit(seed + 1), text_col, id_col)}
