"""Benchmark decontamination by winnowing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_ascii, let, whole

#: Everything but digits, a-z, A-Z and what lies beyond ASCII parts words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
#: Rows of the fingerprint table up to which it is broadcast (of 16 bytes each); above, Spark shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words of whole texts, in order; null and empty texts have none."""
    return F.filter(F.split(whole(text), GAP), lambda w: w != "")


def grams(w: Column, k: int, make) -> Column:
    """make(list of k word columns) for each k consecutive words, by position; null if there are fewer. Each costs k look-ups, whatever the text's length."""
    return let(w, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: make([F.get(w, i + j) for j in range(k)]))))


def gram_hashes(w: Column, k: int) -> Column:
    return grams(w, k, lambda x: F.xxhash64(*x))


def winnow(h: Column, span: int) -> Column:
    """Minimum of each `span` consecutive hashes (of all, if there are fewer), each value once."""
    least = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - span), lambda i: F.least(*[F.get(h, i + j) for j in range(span)]))
    return let(h, lambda h: F.array_distinct(F.when(F.size(h) >= span, least(h)).when(F.size(h) > 0, F.array(F.array_min(h)))))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (win, n, item): each window of `window` words of an item as text; an item of fewer words is one window of n words."""
    w = items.select(F.col(id_col).alias("item"), words(fold_ascii(whole(F.col(text_col)))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    return w.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("win")).distinct()


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items_sha256, items, contaminated.

    Winnowing: of each document, the least hash of every window - gram + 1 consecutive gram-word hashes is a fingerprint; so every run of
    `window` words that a document shares with an item has a fingerprint that is also among the item's. Fingerprints are joined, and each hit
    is extended: all windows of words that contain it are compared, as text, with the items' windows. So the result is exact.
    Items of fewer than `window` words are one window; the same join takes them by the hash of all their words.
    Null, empty and wordless texts have no words; such items never match. Ties between hashes keep one value. Repeated documents (same id
    and text) give one row each; ids are expected to name one text (rows with equal ids and different texts are kept apart).
    An empty items table leaves all documents clean. Other columns are ignored, whatever their names.
    Fingerprints of items are broadcast up to BROADCAST_ROWS rows and shuffled beyond; documents' texts are never shuffled.
    """
    windows = cut(item_windows(items, item_col, item_text, window), "item-windows")
    prints = (
        windows.filter(F.col("n") == window).select(F.explode(winnow(gram_hashes(F.split(F.lower("win"), " "), gram), window - gram + 1)).alias("h")).distinct()
    )
    prints = cut(prints, "fingerprints")
    short = sorted(r[0] for r in windows.filter(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 values
    n_prints, n_windows = prints.count(), windows.count()
    # What is found depends on a text alone, so (k, t) names it: k spreads equal hashes, t is the text's hash.
    number = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if number else F.xxhash64(id_col)
    base = docs.select(F.col(id_col).alias("id"), k.alias("k"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    # Fingerprints are of texts in lower case, on both sides. That merges more than A-Z and only adds candidates, which the comparison below drops.
    loose = base.select("k", "t", words(F.lower(whole(F.col("text")))).alias("w"))
    hits = None
    if n_prints:
        every = loose.select("k", "t", F.explode(winnow(gram_hashes(F.col("w"), gram), window - gram + 1)).alias("h"))
        hits = every.join(_bounded(prints, n_prints), "h", "left_semi").select("k", "t")
    for n in short:
        mine = windows.filter(F.col("n") == n).select(F.explode(gram_hashes(F.split(F.lower("win"), " "), n)).alias("h")).distinct()
        more = loose.select("k", "t", F.explode(F.array_distinct(gram_hashes(F.col("w"), n))).alias("h")).join(_bounded(mine, n_windows), "h", "left_semi").select("k", "t")
        hits = more if hits is None else hits.union(more)
    counted = base.select("id", "k", "t", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")]
    if hits is None:
        return _report(counted.select("id", "n_words", *none), id_col)
    some = cut(hits.distinct(), "candidates")
    # Extension: all windows of the candidates' words against the items' windows, as text.
    few = _bounded(some, some.count())
    exact = base.join(few, ["k", "t"], "left_semi").select("k", "t", "text").distinct()
    w = exact.select("k", "t", words(fold_ascii(whole(F.col("text")))).alias("w"))
    found = None
    for n in [*short, *([window] if n_prints else [])]:
        at = w.filter(F.size("w") >= n).select("k", "t", F.posexplode(grams(F.col("w"), n, lambda x: F.concat_ws(" ", *x))).alias("at", "win"))
        own = _bounded(windows.filter(F.col("n") == n).select("win").distinct(), n_windows)
        mine = at.join(own, "win").select("k", "t", "at", F.lit(n).alias("n"), "win")
        found = mine if found is None else found.union(mine)
    found = cut(found, "found")
    per_doc = found.join(_bounded(windows.select("win", "item"), n_windows), "win").select("k", "t", "item").distinct().groupBy("k", "t").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    # Covered words: starts ascending, each window adds what the ones before it have not covered.
    reach = found.groupBy("k", "t", "at").agg(F.max("n").alias("n")).groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["to"] - F.greatest(s["at"], a["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], s["to"]).alias("end"))
    hit = reach.select("k", "t", F.aggregate("s", zero, step)["n"].alias("n_hit"))
    marked = cut(hit.join(per_doc, ["k", "t"]), "marked")
    marks = _bounded(marked, marked.count())
    return _report(counted.join(marks, ["k", "t"], "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")), id_col)


def _report(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(
        F.col("id").alias(id_col), "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )
