"""Phrases from tables against plain Python and against the rules with phrases in the plan."""

import random
import re

from pyspark.sql import functions as F

from quirelake import config as C
from quirelake.operators import dialog as G
from quirelake.operators import phrases as P

random.seed(21)


def norm(t):
    return re.sub("[^a-z0-9]+", " ", re.sub("['’`]", "", (t or "").lower())).strip()


def test_phrase_hits(spark):
    words = ["a", "b", "c", "don't", "É"]
    phrases = [(str(random.randrange(3)), " ".join(random.choices(words, k=random.randrange(1, 5)))) for _ in range(30)] + [("x", ""), ("x", None), ("y", "A  b!"), ("y", "a b")]
    texts = [None, "", "a", *(random.choice([" ", ", "]).join(random.choices(words, k=random.randrange(30))) for _ in range(25)), "a b " * 500]
    got = sorted((r.id, r.category, r.phrase, r["at"]) for r in P.phrase_hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame(phrases, "category string, phrase string"), "id").collect())
    want = set()
    for i, t in enumerate(texts):
        w = norm(t).split()
        for c, p in {(c, norm(p)) for c, p in phrases if norm(p)}:
            n = len(p.split())
            want |= {(i, c, p, k) for k in range(len(w) - n + 1) if w[k : k + n] == p.split()}
    assert got == sorted(want) and len(want) > 100
    none = spark.createDataFrame([], "category string, phrase string")
    assert P.phrase_hits(spark.createDataFrame([(1, "a")], "id int, text string"), none, "id").count() == 0


def test_utterances_by_table_as_by_rules(spark):
    phrases = {"greeting": ["hi", "hey", "heyy", "good morning"], "how_are_you": ["how are you"], "ack": ["ok", "yes"], "capabilities": ["what can you do"]}
    said = ["Heyyyy!", "hi there", "hi how are you", "hi what is the leave policy", "ok", "", "hey yes", "good morning team", "good morning, what can you do?", "ok buddy", "hey how are you all", "how are you everyone", "hi hi", None, "one two three four five six seven", "good morning how are you team"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    table = spark.createDataFrame([(c, p) for c, ps in phrases.items() for p in ps], "category string, phrase string")
    want = {r.id: r.k for r in df.select("id", G.smalltalk(F.col("text"), phrases).alias("k")).collect() if r.k}
    got = {r.id: r.category for r in P.utterance_category(df, table, ["id"], address=C.ADDRESS_WORDS, leadable=C.LEADABLE).collect()}
    assert got == want and len(want) > 6
