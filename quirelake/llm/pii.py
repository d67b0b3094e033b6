"""Personal data: patterns, and terms that disclose what the patterns find. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_small, fold_ascii, let, whole
from .decontam import words

#: Shortest terms; code points around an entity that are its context; least disclosure, and that from which a term is removed rather than generalised.
SHORTEST, CONTEXT, DISCLOSURE, REMOVED = 3, 80, 0.6, 0.8
#: Standard deviations by which a share is lowered: a one-sided bound of 75 %.
BOUND = 0.67
#: Code points of a bucket, in which spans of a text meet.
BUCKET = 256
BROADCAST_ROWS = 1_000_000

# The contract's patterns, written so that a search takes linear time and no deep recursion: runs are possessive where that changes no match, and
# a search does not start again inside a run in which it has failed (\G: where the match before ended).
_LETTER = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.char_length(digits)
    digit = lambda i: F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def matches(text: Column, pattern: Column | str, kind: str, valid=None, value=None) -> Column:
    """Spans (kind, start, end, value) of a pattern's matches from left to right, in code points; `valid` drops matches, `value` normalises them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    span = F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))
    none = F.filter(F.array(span), lambda x: F.lit(False))

    def walk(found: Column) -> Column:
        """found: pieces between matches, and the matches."""
        both = F.arrays_zip(F.slice(found["p"], F.lit(1), F.size(found["m"])).alias("p"), found["m"].alias("m"))
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.char_length(x["p"])
            end = start + F.char_length(x["m"])
            one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), (value(x["m"]) if value else x["m"]).alias("value")))
            good = valid(x["m"]) if valid else F.lit(True)
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(both, zero, step)["out"]

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m")), walk)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by kind and start. Each pattern is tried only on texts that hold a character it needs."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    count = lambda m: F.char_length(digits(m))
    span = F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))
    none = F.filter(F.array(span), lambda x: F.lit(False))
    numbers = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email", None, F.lower)).otherwise(none),
        F.when(numbers & text.rlike(r"[0-9]\.[0-9]"), matches(text, IP, "ip", lambda m: m.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"))).otherwise(none),
        F.when(numbers, matches(text, CARD, "card", lambda m: F.when(count(m).between(13, 19), luhn(digits(m))).otherwise(False), digits)).otherwise(none),
        F.when(numbers & F.contains(text, F.lit("+")), matches(text, PHONE, "phone", lambda m: count(m).between(9, 15), digits)).otherwise(none),
    )


def terms_of(text: Column, shortest: int = SHORTEST) -> Column:
    """Distinct words of `shortest` characters or more that are not numbers."""
    return F.array_distinct(F.filter(words(fold_ascii(text)), lambda w: (F.char_length(w) >= shortest) & w.rlike("[^0-9]")))


#: A piece of a text: PIECE code points and the rest of the word that they end in. Words are never cut, and places are summed within pieces and over them.
PIECE = 400
_PIECES = rf"(?s).{{1,{PIECE}}}{_LETTER}*+"


def _placed(parts: Column, start: Column) -> Column:
    """(text, start, end) of texts that follow one another."""
    one = lambda x, at: F.array(F.struct(x.alias("text"), at.alias("start"), (at + F.char_length(x)).alias("end")))
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))
    return F.aggregate(parts, zero, lambda a, x: F.struct((a["at"] + F.char_length(x)).alias("at"), F.concat(a["out"], one(x, a["at"])).alias("out")))["out"]


def pieces(texts: DataFrame) -> DataFrame:
    """texts with a row for each piece of `text`, as piece (text, start, end)."""
    return texts.withColumn("piece", F.explode(_placed(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0)), F.lit(0)))).drop("text")


def terms_in(piece: Column, shortest: int = SHORTEST) -> Column:
    """(text, start, end) of a piece's terms."""
    runs = F.regexp_extract_all(piece["text"], F.lit(rf"{_LETTER}++|[^{_LETTER[1:]}++"), F.lit(0))
    return F.filter(_placed(runs, piece["start"]), lambda x: (x["end"] - x["start"] >= shortest) & x["text"].rlike(rf"\A{_LETTER}") & x["text"].rlike("[^0-9]"))


def words_at(texts: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(t1, t2, word, term, start, end) of the terms of texts (t1, t2, text), at every place, where the texts lie."""
    rows = pieces(texts.select("t1", "t2", "text")).select("t1", "t2", F.explode(terms_in(F.col("piece"), shortest)).alias("x"))
    return rows.select("t1", "t2", F.col("x.text").alias("word"), fold_ascii(F.col("x.text")).alias("term"), "x.start", "x.end")


def _buckets(rows: DataFrame) -> DataFrame:
    """rows with `bucket`, one for each that [start, end) touches."""
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))


def lower_bound(k: Column, n: Column, z: float = BOUND) -> Column:
    """The least share that k of n stands for, z standard deviations down (Wilson)."""
    p, zz = k / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def held_entities(found: DataFrame) -> DataFrame:
    """(kind, value, start, end, t1, t2): each place of each entity, of distinct texts."""
    return found.dropDuplicates(["t1", "t2"]).select("t1", "t2", F.explode("spans").alias("s")).select("s.kind", "s.value", "s.start", "s.end", "t1", "t2")


def ratings(found: DataFrame, docs: DataFrame, text_col: str, shortest: int = SHORTEST, context: int = CONTEXT) -> DataFrame | None:
    """(kind, value, term, n_both, n_term, disclosure): every term of every entity's context, or None without entities.

    A term's disclosure of an entity is the chance that a text that says the term says it in the entity's context (up to `context` code points away): n_both of n_term
    distinct texts, lowered by a confidence bound. So it depends on what the term reveals, not on the corpus' size; a term that one text alone says
    reveals what stands beside it. found: (t1, t2, text, spans) of the texts with spans.
    """
    held = cut(held_entities(found), "entities")
    if held.isEmpty():
        return None
    # Pieces with an entity in reach, their terms, and of those the ones in an entity's context: all where the texts lie.
    reach = lambda x, around: lambda e: (e["start"] < x["end"] + around) & (x["start"] < e["end"] + around)
    rows = pieces(found.dropDuplicates(["t1", "t2"]).select("t1", "t2", "text", "spans")).withColumn("spans", F.filter("spans", reach(F.col("piece"), context))).filter(F.size("spans") > 0)
    rows = rows.select("t1", "t2", "spans", F.explode(terms_in(F.col("piece"), shortest)).alias("x"))
    rows = rows.select("t1", "t2", fold_ascii(F.col("x.text")).alias("term"), F.explode(F.filter("spans", lambda e: reach(F.col("x"), context)(e) & ~reach(F.col("x"), 0)(e))).alias("e"))
    both = rows.select("e.kind", "e.value", "term", "t1", "t2").distinct().groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n_both")).withColumn("h", F.xxhash64("term"))
    both = cut(both, "pairs")
    candidates = cut(both.select("h").distinct(), "candidates")
    # Copies of a text count as one: each has its share of 1, so that terms are summed before they are shuffled.
    names = [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2")]
    copies = docs.select(*names).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    every = docs.select(*names, F.col(text_col).alias("text")).join(cut_small(copies, "copies"), ["t1", "t2"], "left")
    hashes = F.transform(terms_of(whole(F.col("text")), shortest), lambda w: F.xxhash64(w))
    every = every.select((F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(hashes).alias("h"))
    # Too many to broadcast: all terms are summed first.
    every = every.join(F.broadcast(candidates), "h", "left_semi") if candidates.count() <= BROADCAST_ROWS else every
    n_term = every.groupBy("h").agg(F.round(F.sum("share")).cast("long").alias("n_term"))
    return both.join(n_term, "h").select("kind", "value", "term", "n_both", "n_term", lower_bound(F.col("n_both"), F.greatest("n_term", "n_both")).alias("disclosure"))


def generalised(word: Column) -> Column:
    """What a word is put down to: a code, a name or a word."""
    return F.when(word.rlike("[0-9]"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def term_spans(disclosing: DataFrame, texts: DataFrame, found: DataFrame, shortest: int = SHORTEST, removed: float = REMOVED) -> DataFrame:
    """(t1, t2, _terms): the spans of disclosing terms (term, disclosure) in each distinct text that says any, but for those that overlap base spans (found).

    Words of such texts are joined to terms by hash and compared; whole texts move only if they say a term. value is what a span is replaced by."""
    listed = cut(disclosing.groupBy("term").agg(F.max("disclosure").alias("disclosure")).withColumn("h", F.xxhash64("term")), "disclosing")
    few = lambda df: F.broadcast(df) if listed.count() <= BROADCAST_ROWS else df
    said = texts.select("t1", "t2", F.explode(F.transform(terms_of(F.col("text"), shortest), lambda w: F.xxhash64(w))).alias("h")).join(few(listed.select("h")), "h", "left_semi")
    telling = cut_small(said.select("t1", "t2").distinct(), "telling")
    words_ = words_at(texts.join(telling, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]), shortest).withColumn("h", F.xxhash64("term"))
    put = F.when(F.col("disclosure") >= removed, "[TERM]").otherwise(generalised(F.col("word")))
    spans = cut(words_.join(few(listed), ["h", "term"]).select("t1", "t2", F.lit("term").alias("kind"), "start", "end", put.alias("value")), "term-spans")
    base = _buckets(held_entities(found)).select("t1", "t2", "bucket", F.col("start").alias("s"), F.col("end").alias("e"))
    over = _buckets(spans).join(base, ["t1", "t2", "bucket"]).filter((F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))).select("t1", "t2", "start").distinct()
    clear = spans.join(over, ["t1", "t2", "start"], "left_anti")
    return clear.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("_terms"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, threshold: float = DISCLOSURE, removed: float = REMOVED, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_base (base spans of all kinds), and with_text the sanitised text.

    spans lists kind:start:end by kind (email, ip, card, phone, term), then start, comma-joined; code points, end exclusive. Base spans are the
    patterns' matches. A term that discloses any entity (see ratings) is marked in all texts, with base spans or without, wherever it does not overlap a base span.
    In the sanitised text, spans are replaced by their kinds, overlapping ones by the first; terms are generalised to [CODE], [NAME] or [WORD], and those that disclose
    `removed` or more are removed ([TERM]). Null and empty texts have no spans. Repeated rows each give a row and count as one text in the statistics. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    text = whole(F.col(text_col))
    names = [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2")]
    first = docs.select(F.col(id_col).alias("id"), *names, text.alias("text"), base_spans(text).alias("spans"))
    all_ = cut(first.withColumn("text", F.when((F.size("spans") > 0) | F.lit(with_text), F.col("text"))), "spans")
    found = all_.filter(F.size("spans") > 0).select("t1", "t2", "text", "spans")
    rated = ratings(found, docs, text_col, shortest)
    none = F.slice("spans", 1, 0)
    if rated is None:
        both = all_.withColumn("more", none)
    else:
        marks = term_spans(rated.filter(F.col("disclosure") >= threshold).select("term", "disclosure"), docs.select(*names, text.alias("text")), found, shortest, removed)
        both = all_.join(cut_small(marks, "marks"), ["t1", "t2"], "left").withColumn("more", F.coalesce("_terms", none)).drop("_terms")
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = [F.col("id").alias(id_col), *map(count, ("email", "ip", "card", "phone")), F.sha2(name(F.col("spans")).cast("binary"), 256).alias("base_sha256"), name(F.concat("spans", "more")).alias("spans"), F.size("more").cast("long").alias("n_term"), F.size("spans").cast("long").alias("n_base")]
    return both.select(*out, *([sanitised(F.col("text"), F.concat("spans", "more")).alias("sanitised")] if with_text else []))


def sanitised(text: Column, spans: Column) -> Column:
    """text with spans replaced by placeholders (of terms, by their values); of overlapping ones, the first counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    names = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.when(s["kind"] == "term", s["value"]).otherwise(F.try_element_at(names, s["kind"])))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(a)

    return F.when(F.size(spans) > 0, let(F.aggregate(order, zero, step), lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))).otherwise(text)
