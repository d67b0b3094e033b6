import re

from pyspark.sql import functions as F

from quirelake.functions import text as T


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x")).alias("y")).head()[0]


def test_normalising(spark):
    assert one(spark, "What's  UP—now?", T.normalise_utterance) == "whats up now"
    assert one(spark, "heyyyy thereee", T.squeeze) == "heyy theree"
    assert one(spark, " A\t b\n\nC ", T.squash) == "a b c"
    assert one(spark, "Leave & Pay (2024)", T.normalise_title) == "leave pay 2024"
    assert one(spark, "infor-\nmation ﬁne​ a\n\n\n\nb", lambda c: T.unicode_normalise(T.dehyphenate(c))) == "information fine a\n\nb"
    assert one(spark, "l am c0ol | ok\n\nnow", T.ocr_clean) == "I am cool I ok now"


def test_measures(spark):
    assert one(spark, "one two three", T.token_estimate) == 3
    assert one(spark, "", T.token_estimate) == 0
    assert one(spark, "x" * 60, T.garbled) is True
    assert one(spark, "", T.garbled) is False
    assert one(spark, "a plain sentence", T.garbled) is False


def test_truncate(spark):
    long = "a" * 300 + "b" * 300
    cut = one(spark, long, lambda c: T.truncate(c, 400, F.lit(True)))
    assert len(cut) == 400 and cut.endswith("b" * 133) and " ... " in cut
    assert one(spark, long, lambda c: T.truncate(c, 400, F.lit(False))) == long[:400]
    assert one(spark, "short", lambda c: T.truncate(c, 400, F.lit(True))) == "short"


def test_phrases(spark):
    assert one(spark, "is there a way out", lambda c: T.has_phrase(c, ["there a way"])) is True
    assert one(spark, "is there away", lambda c: T.has_phrase(c, ["there a way", ""])) is False
    assert one(spark, "u have docs rn", lambda c: T.expand_informal(c, {"u": "you", "docs": "documents", "rn": ""})) == "you have documents"
    assert one(spark, "Sure. Would you like more? Bye.", lambda c: T.offer_sentence(c, ["would you like"])) == "Would you like more?"
    assert one(spark, "One. Two", lambda c: T.offer_sentence(c, ["would you like"])) == "Two"


def test_titles(spark):
    assert one(spark, "LEAVE POLICY", T.display_title) == "Leave Policy"
    assert one(spark, "Acme Performance Plan (PIP) Policy - India", lambda c: T.topic_title(c, "acme")) == "performance plan"
    assert one(spark, "3.1 SCOPE & USE:", lambda c: T.clean_section(c, F.lit("Title"), ["scope"], [], False)) == "Scope and Use"
    assert one(spark, "2. Scope", lambda c: T.clean_section(c, F.lit("Title"), ["scope"], [], False)) is None
    assert one(spark, "Title > 2. Leave > Scope", lambda c: T.best_section(c, F.lit("Title"), ["scope"], [], False)) == "Leave"
    assert tuple(one(spark, "Answer. [[TITLE: Sick days]]", T.split_title)) == ("Answer.", "Sick days")


def test_structures(spark):
    rows = [["a", "b"], ["1"], ["2", "3", "4"]]
    assert one(spark, rows, T.rows_to_markdown, "x array<array<string>>") == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert one(spark, rows, T.row_mismatch, "x array<array<string>>") is True
    assert one(spark, [["a", "b", "c"]], T.real_table, "x array<array<string>>") is False
    assert one(spark, ["a", "b", "c"], T.join_words, "x array<string>") == "a, b and c"
    assert one(spark, ["a"], T.join_words, "x array<string>") == "a"
    assert tuple(one(spark, "12 March 2024", T.date_or_version)) == ("12 March 2024", None)
    assert tuple(one(spark, "v2.1", T.date_or_version)) == (None, "v2.1")
    assert one(spark, "HR: Leave/2024!", T.id_prefix) == "HR_Leave_2024"
    assert one(spark, "{a} of {b}", lambda c: T.render(c, "x {a}", a=F.lit("1"))) == "x 1"
    assert one(spark, "see {a}", lambda c: T.render(c, "x {a}", a=F.lit("1"))) == "see 1"


def test_one_pass(spark):
    """Stripping, words and garbled texts as regular expressions tell them, each read once."""
    blanks = "".join(map(chr, range(0x3100)))
    blanks = "".join(c for c in blanks if re.fullmatch(r"\s", c) and c not in "\x1c\x1d\x1e\x1f")
    texts = [None, "", " ", blanks, blanks + "é x" + blanks, "\x1fa\x1f", "a" * 60, "é" * 30 + " 1", "?! .. --", "𝒜 𝒷!", "a b　c\n\nd", " \x85 a", "a​b ﻿", *(f"{p}word{q} and,more{p}" for p in blanks[:9] for q in blanks[-9:])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    strip = F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "")
    words = F.size(F.filter(F.split(F.col("t"), r"(?U)\s+"), lambda w: w != ""))
    n, letters, solid = F.char_length(strip), F.char_length(F.regexp_replace(strip, r"(?U)[^\p{L}\p{N}]", "")), F.char_length(F.regexp_replace(strip, r"(?U)\s", ""))
    garbled = (n > 0) & ((letters / solid < 0.5) | ((n > 40) & (words < n / 25)) | (solid / words > 25))
    ways = {"strip": (T.strip(F.col("t")), strip), "words": (T.word_count(F.col("t")), words), "garbled": (T.garbled(F.col("t")), garbled), "some": (T.has_text(F.col("t")), strip != "")}
    rows = df.select("t", *[x.alias(f"{k}{j}") for k, pair in ways.items() for j, x in enumerate(pair)]).collect()
    assert all(r[f"{k}0"] == r[f"{k}1"] for r in rows for k in ways) and {r.garbled0 for r in rows} == {None, True, False}
    plan = df.select(T.garbled(F.col("t")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(", plan)) == 1 and plan.count("trim(") == 1
