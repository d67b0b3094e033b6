"""Phrases from a table, however many: found in texts by joins on their words, not as literals of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import small, written


def phrase_trie(phrases: DataFrame) -> DataFrame:
    """(category, phrase, w, h): normalised phrases with their words and the hash of all of them; blank ones are left out, repeated ones are one."""
    rows = phrases.select("category", T.normalise_utterance(F.col("phrase")).alias("phrase")).filter("phrase <> ''").distinct()
    return rows.withColumn("w", F.split("phrase", " ")).withColumn("h", _hash(F.col("w")))


def _hash(words: Column) -> Column:
    """Of a run of words, from the hash of the run without the last and that word: as a walk down a trie."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w))


def phrase_hits(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, category, phrase, at): each place (word, from 0) of each text (normalised) where a phrase of the table (category, phrase) stands as whole words.

    A trie join: words that begin a phrase are kept, then the runs that start there are walked word by word, and their hashes are joined to the ends of phrases and
    compared. Tables up to a measured size are broadcast; larger ones are shuffled by word and by hash. Null texts have no words."""
    trie = written(phrase_trie(phrases), "phrases")
    most = trie.agg(F.max(F.size("w"))).head()[0] or 0
    firsts = small(trie.select(F.get("w", F.lit(0)).alias("first")).distinct(), "first-words")
    w = F.split(T.normalise_utterance(F.col(text_col)), " ")
    rows = texts.select(F.col(id_col).alias("id"), w.alias("w")).select("id", F.posexplode(F.transform("w", lambda x, i: F.slice(F.col("w"), i + 1, most))).alias("at", "run"))
    rows = rows.withColumn("first", F.get("run", F.lit(0))).join(firsts, "first").drop("first")
    step = lambda a, x: F.struct(F.xxhash64(a["h"], x).alias("h"), F.concat(a["all"], F.array(F.xxhash64(a["h"], x))).alias("all"))
    walked = F.aggregate("run", F.struct(F.lit(0).cast("long").alias("h"), F.array().cast("array<bigint>").alias("all")), step, lambda a: a["all"])
    ends = rows.select("id", "at", "run", F.posexplode(walked).alias("n", "h"))
    met = ends.join(small(trie, "phrase-ends"), "h").filter(F.slice("run", F.lit(1), F.col("n") + 1) == F.col("w"))
    return met.select(F.col("id").alias(id_col), "category", "phrase", "at")


def utterance_category(turns: DataFrame, phrases: DataFrame, id_cols: list[str], most_words: int = 6, address: tuple[str, ...] = (), leadable: tuple[str, ...] = (), greeting: str = "greeting") -> DataFrame:
    """(id_cols..., category) of turns whose whole utterance is a phrase: as it is, with a word of address behind, or behind a greeting in leadable categories.

    Each utterance has a few readings, which are joined to the table; the first that is there counts, categories by name where a phrase has several."""
    norm = T.squeeze(T.normalise_utterance(F.col("text")))
    rows = turns.select(*id_cols, norm.alias("norm")).filter("norm <> ''").withColumn("w", F.split("norm", " ")).filter(F.size("w") <= most_words)
    join = lambda a: F.array_join(a, " ")
    cut = F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))
    plain = F.array(F.struct(F.lit(0).alias("nth"), F.lit("").alias("lead"), F.col("norm").alias("said")), F.when((F.size("w") > 1) & F.element_at("w", -1).isin(*address), F.struct(F.lit(100).alias("nth"), F.lit("").alias("lead"), join(cut).alias("said"))))
    led = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(i.alias("nth"), join(F.slice("w", 1, i)).alias("lead"), join(F.slice("w", i + 1, F.size("w"))).alias("said"))))
    short = F.size("w") > 2
    led_cut = F.when(short & F.element_at("w", -1).isin(*address), F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct((i + 100).alias("nth"), join(F.slice("w", 1, i)).alias("lead"), join(F.slice("w", i + 1, F.size("w") - 1 - i)).alias("said"))))
    empty = F.array().cast("array<struct<nth:int,lead:string,said:string>>")
    readings = rows.select(*id_cols, F.explode(F.filter(F.concat(plain, F.coalesce(led, empty), F.coalesce(led_cut, empty)), lambda x: x.isNotNull())).alias("x")).select(*id_cols, "x.*")
    table = phrase_trie(phrases).select("category", "phrase")
    hello = small(table.filter(F.col("category") == greeting).select(F.col("phrase").alias("lead")).unionByName(phrases.sparkSession.createDataFrame([("",)], "lead string")).distinct(), "greetings")
    met = readings.join(small(table.withColumnRenamed("phrase", "said"), "categories"), "said").join(hello, "lead", "left_semi").filter((F.col("lead") == "") | F.col("category").isin(*leadable))
    return met.groupBy(*id_cols).agg(F.min(F.struct("nth", "category"))["category"].alias("category"))
