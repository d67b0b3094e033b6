"""Spelling variants: words at an edit distance of one, by self-joins of a partitioned vocabulary trie with active nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_small, fold_ascii, release, whole

#: A word: so many code points and occurrences at least. One run in so many loses a code point. How much more frequent a form is than its variant.
LEAST_LENGTH, LEAST_COUNT, EVERY, RATIO = 5, 3, 97, 2
#: Words of a trie's part above which it is divided again; words that a task joins at a time.
CROWD, BATCH = 20_000, 40_000
RUN = "[a-zÀ-ÿ]+"
_CHAR = 21  # bits of a code point


def misspelt(run: Column, doc_id: Column, every: int = EVERY) -> Column:
    """The run, or where `every` divides the CRC of '<id>:<run>', the run without the code point that the CRC modulo its length names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): words of whole texts with their occurrences; summed before they are shuffled."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(fold_ascii(whole(F.col(text_col))), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(misspelt(F.col("run"), F.col("id"), every).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def parts(words: DataFrame, least_length: int = LEAST_LENGTH, crowd: int = CROWD) -> DataFrame:
    """(word, n, c, f, g, key): each word in the parts of the trie in which near words of it may lie.

    Near words have c and c, or c and c + 1, code points. If they agree on the first half of c, they lie below one node of the trie of words: the part of that
    prefix (f code points). Otherwise they agree on the other half: the part of a prefix of the mirrored trie (g code points at the end). A part with more
    than `crowd` words is divided in the same way: the edit is in the first or in the second half of what its words don't share. So a frequent prefix
    is no large part, and each pair is looked for in one part alone. key, a hash,
    only brings a part's words together."""
    length = F.char_length("word")
    c = words.select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda c: c >= least_length)).alias("c"))

    def divided(rows: DataFrame) -> DataFrame:
        m = F.col("c") - F.col("f") - F.col("g")
        a = F.floor(m / 2).cast("int")
        ways = F.array(F.struct((F.col("f") + a).alias("f"), F.col("g").alias("g")), F.struct(F.col("f").alias("f"), (F.col("g") + m - a).alias("g")))
        out = rows.select("word", "n", "c", F.explode(ways).alias("x")).select("word", "n", "c", "x.f", "x.g")
        ends = F.substr("word", F.lit(1), F.col("f")), F.substr("word", F.char_length("word") - F.col("g") + 1, F.col("g"))
        return out.withColumn("key", F.xxhash64("c", "f", "g", *ends))

    rows, done = divided(c.withColumns({"f": F.lit(0), "g": F.lit(0)})), None
    while True:
        large = cut_small(rows.filter("c - f - g > 1").groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("key"), "large-parts")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(large, "key", "left_anti").select(*rows.columns)
        done = fine if done is None else done.unionByName(fine)
        rows = divided(rows.join(large, "key", "left_semi"))


class Forest:
    """Tries of several parts, a root for each, built level by level: node numbers ascend by level, parent and code point, so that `edges` is sorted."""

    def __init__(self, texts: list[str], part: np.ndarray) -> None:
        """texts: what remains of each word of a part; part: numbers from 0 on."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size) - size
        self.roots = int(part.max()) + 1
        at, edges, total = part.astype(np.int64), [], self.roots
        self.levels = [np.arange(self.roots)]
        live = np.flatnonzero(size > 0)
        depth = 0
        while len(live):
            found, back = np.unique(at[live] << _CHAR | codes[start[live] + depth], return_inverse=True)
            at[live] = total + back
            self.levels.append(np.arange(total, total + len(found)))
            edges.append(found)
            total += len(found)
            depth += 1
            live = live[size[live] > depth]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.edges, np.arange(total + 1) << _CHAR)  # of a node's edges
        self.word = np.full(total, -1)  # that ends at a node
        self.word[at] = np.arange(len(texts))

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, child) of all children."""
        n = self.first[nodes + 1] - self.first[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return of, self.roots + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[nodes], n)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of words at distance one, a level at a time: of equal length, or the second one longer.

        A node's active nodes are those whose text is at distance one from its own and no shorter. They come from the active nodes of its parent, by the same
        code point; from its siblings, by another one; and from its own children, by one more. What stands at distance 0 is the node itself."""
        none = np.zeros(0, np.int64)
        u, v = none, none
        for nodes in self.levels:
            if len(u):
                of, down = self.children(u)
                want = v[of] << _CHAR | self.edges[down - self.roots] & ((1 << _CHAR) - 1)
                place = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
                same = self.edges[place] == want
                u, v = down[same], self.roots + place[same]
            of, down = self.children(nodes)
            pairs = [u << 32 | v, nodes[of] << 32 | down]
            if nodes[0] >= self.roots and len(nodes) > 1:  # siblings: those that follow a node below its parent
                parent = self.edges[nodes - self.roots] >> _CHAR
                after = np.searchsorted(parent, parent, "right") - np.arange(len(nodes)) - 1
                of = np.repeat(np.arange(len(nodes)), after)
                step = np.arange(len(of)) - np.repeat(np.cumsum(after) - after, after) + 1
                pairs.append(nodes[of] << 32 | nodes[of + step])
            both = np.unique(np.concatenate(pairs))
            u, v = both >> 32, both & 0xFFFFFFFF
            ends = (self.word[u] >= 0) & (self.word[v] >= 0)
            yield self.word[u[ends]], self.word[v[ends]]


def _joined(rows: list[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of rows (word, n, c, f, g) of near words, once: of those that lie in one part, with the first difference where the part is to look for it."""
    known: dict[tuple, int] = {}
    part = np.array([known.setdefault((c, f, g, w[:f], w[len(w) - g :]), len(known)) for w, _, c, f, g in rows], np.int64)
    many = np.bincount(part)[part] > 1
    rows = [r for r, m in zip(rows, many.tolist(), strict=True) if m]
    if not rows:
        return
    forest = Forest([w[f : len(w) - g] for w, _, _, f, g in rows], np.unique(part[many], return_inverse=True)[1])
    for a, b in forest.near():
        for i, k in zip(a.tolist(), b.tolist(), strict=True):
            (x, _, c, _, g), y = rows[i], rows[k][0]
            if len(x) == c and (not g or x[: c - g] != y[: c - g]):
                yield rows[i], rows[k]


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, crowd: int = CROWD, batch_rows: int = BATCH) -> DataFrame:
    """(word, n, other, n_other): every ordered pair of near words, once."""

    def run(batches) -> Iterator:
        release()
        held: list[tuple] = []
        keys: list[int] = []

        def joined(count: int):
            got = [(*x[:2], *y[:2]) for pair in _joined(held[:count]) for x, y in (pair, pair[::-1])]
            for i in range(0, len(got), batch_rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[i : i + batch_rows], strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "other", "n_other"])
            del held[:count], keys[:count]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys += columns[0]
            held += zip(*columns[1:], strict=True)
            if len(keys) >= batch_rows:  # whole parts; the last one may go on
                last = np.array(keys) != keys[-1]
                count = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if count:
                    yield from joined(count)
        yield from joined(len(keys))

    dealt = parts(words, least_length, crowd).select("key", "word", "n", "c", "f", "g")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, n long, other string, n_other long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where a chain of forms ends, by pointer doubling. Each step at least doubles the occurrences, so chains are short and have no cycles."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, ratio: int = RATIO, crowd: int = CROWD, batch_rows: int = BATCH) -> DataFrame:
    """One row per word: word, n, form, form_n, root, n_near.

    Words are the maximal runs of letters of whole texts (A-Z lower-cased, one in `every` without a code point) with at least `least_length` code points and
    `least_count` occurrences. Words are near if one inserted, deleted or replaced code point parts them. A word's form is its most frequent near word (ties: the
    smallest in code-point order) if that has `ratio` times its occurrences, else null; its root is where its forms lead, or itself.
    Null and empty texts have no words; null ids count as empty ones; repeated rows count each. A table without words gives no rows. Other columns are
    ignored, whatever their names.
    """
    words = cut(vocabulary(docs, id_col, text_col, least_length, least_count, every), "vocabulary")
    pairs = near_words(words, least_length, crowd, batch_rows)
    best = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("k"), "other")).alias("b"))
    best = best.select("word", "n_near", F.when(-F.col("b.k") >= ratio * F.col("n"), F.struct(F.col("b.other").alias("form"), (-F.col("b.k")).alias("form_n"))).alias("f"))
    best = cut(best.select("word", "n_near", "f.form", "f.form_n"), "near-words")
    root = roots(best.filter("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
