"""A training corpus from raw documents: STAGES in order, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontam, jaccard, mixing, queries, tokens, toxicity
from quirelake.llm.common import cut, cut_small, row_key


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Of each stage: null and empty texts, null and repeated ids, repeated rows, empty tables and further columns of any name are fine. A row's columns travel as one
# (doc), so that none is taken for the stage's own.


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have the score of no words; rows with equal texts, whatever their ids, share their fate."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs.select(F.struct("*").alias("doc"), "text"), model)
    return _unpacked(rows.filter(F.col("score") < toxicity.THRESHOLD))


def _row(docs: DataFrame) -> tuple[Column, bool]:
    """What names a row, and whether rows may repeat it: the id, or where ids are missing or repeated, id and text."""
    unique = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()
    return (F.col("doc_id") if unique else row_key("doc_id", "text")).alias("row"), not unique


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays, one without an id only where none has one; of rows with one id and text, one.
    Rows go by id and text, so one that shares only its id with a near copy stays. Rows without words and id stay."""
    row, repeated = _row(docs)
    classes = cut(jaccard.jaccard_classes(docs.select(row, "text"), "row").select("row", "n_shingles", "component_id"), "classes")
    # What goes is a list of rows' names; texts aren't shuffled for it, unless they repeat.
    gone = cut_small(classes.filter("row <> component_id").select("row").distinct(), "near-copies")
    kept = docs.select(F.struct("*").alias("doc"), row).join(gone, "row", "left_anti")
    if not repeated:
        return _unpacked(kept)
    twice = cut(classes.filter("NOT row.missing OR n_shingles > 0").groupBy("row").count().filter("count > 1").select("row"), "repeated-rows")
    return _unpacked(kept.join(twice, "row", "left_anti").unionByName(kept.join(twice, "row", "left_semi").dropDuplicates(["row"])))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, by id and text: with or without an id, and no others that share the id."""
    row, _ = _row(docs)
    marks = decontam.decontaminate(docs.select(row, "text"), _table(spark, sf_dir, "benchmark"), "row")
    gone = cut_small(marks.filter("contaminated").select("row").distinct(), "contaminated")
    return _unpacked(docs.select(F.struct("*").alias("doc"), row).join(gone, "row", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document that takes words of it. Documents without words have none; a null source is a source."""
    return mixing.mix_texts(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files; a row for each document of the mix, read back from them. A text without words, null or not, is the end id alone; rows that repeat an id
    follow one another, those without one come first."""
    return tokens.token_output(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

#: Not expressible: a fitted classifier, pseudorandom permutations and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
