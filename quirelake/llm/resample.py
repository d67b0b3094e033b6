"""Importance resampling towards a target distribution: word n-grams in tries, a trie for each partition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ahead
from .common import ALNUM, buffers, cut, release, words_in

#: Longest features in words, buckets, draws in a hundred eligible documents, words that make a document eligible, seed.
MOST, BUCKETS, SHARE, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Nodes of a trie; a fuller one hands over its counts and starts anew.
NODES = 400_000

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


class Trie:
    """Word n-grams of a partition. A node stands for a run of words: the CRC state of its text goes on from its parent's, and it holds how often the run
    occurred (or what it gains). Nodes are numbered; 0 is the root, and a word's number is that of its node below the root."""

    def __init__(self) -> None:
        self.children: dict[tuple[int, int] | bytes, int] = {}
        self.words: dict[int, bytes] = {}
        self.crc: list[int] = [0]

    def __len__(self) -> int:
        return len(self.crc)

    def word(self, word: bytes) -> int:
        node = self.children.get(word)
        if node is None:
            node = self.children[word] = len(self.crc)
            self.words[node] = word
            self.crc.append(zlib.crc32(word))
        return node

    def child(self, node: int, word: int) -> int:
        got = self.children.get((node, word))
        if got is None:
            got = self.children[node, word] = len(self.crc)
            self.crc.append(zlib.crc32(self.words[word], zlib.crc32(b" ", self.crc[node])))
        return got

    def walk(self, data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Of a buffer of texts: the words of each row, and for 1, 2, .. `most` words the nodes that its runs end at, by row, with how many each row has."""
        data = _FOLDED[data]
        starts, ends, first = words_in(data, offsets, ALNUM)
        n_words = np.diff(first)
        # The distinct words of the buffer by Arrow's dictionary; only those are looked up one by one.
        size = ends - starts
        bounds = np.append(0, np.cumsum(size)).astype(np.int32)
        letters = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[letters]))]).dictionary_encode()
        known = np.array([self.word(w) for w in words.dictionary.to_pylist()], np.int64)
        word = known[words.indices.to_numpy()] if len(size) else np.zeros(0, np.int64)
        node, out, left = word, [(word, n_words)], n_words
        row = np.repeat(np.arange(len(n_words)), n_words)
        for k in range(2, most + 1):
            # A run goes on where the word after it is of the same row.
            at = np.arange(max(0, len(word) - k + 1))
            inside = row[at] == row[at + k - 1]
            at = at[inside]
            pairs, back = np.unique(node[at] << 32 | word[at + k - 1], return_inverse=True)
            nodes = np.array([self.child(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], np.int64)
            grown = np.zeros(len(word), np.int64)
            grown[at] = nodes[back] if len(at) else nodes
            node, left = grown, np.maximum(left - 1, 0)
            out.append((grown[at], left))
        return n_words, out

    def buckets(self, buckets: int) -> np.ndarray:
        """Of each node; the root's means nothing."""
        return np.array(self.crc, np.int64) % buckets


def bucket_totals(texts: DataFrame, text_col: str, most: int = MOST, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """(bucket, n): how many features of the whole texts fall into each bucket; empty ones are left out. Tries stay where they are; a row for each bucket and
    trie is shuffled."""

    def count(batches) -> Iterator:
        release()
        trie, sums = Trie(), np.zeros(1024, np.int64)

        def totals():
            got = np.zeros(buckets, np.int64)
            np.add.at(got, trie.buckets(buckets)[1:], sums[1 : len(trie)])
            at = np.flatnonzero(got)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["bucket", "n"])

        for batch in batches:
            for _, _, data, offsets in buffers(batch.column(0)):
                for node, _ in trie.walk(data, offsets, most)[1]:
                    if len(sums) < len(trie):
                        sums = np.append(sums, np.zeros(2 * len(trie) - len(sums), np.int64))
                    sums[: len(trie)] += np.bincount(node, minlength=len(trie))
                if len(trie) > nodes:
                    yield totals()
                    trie, sums = Trie(), np.zeros(1024, np.int64)
        yield totals()

    got = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return got.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, floor(1000 * ln of its smoothed share in target over that in raw): at most `buckets` numbers, whatever the input."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    side = lambda df, n: df.select("bucket", F.col("n").cast("double").alias(n))
    both = every.join(side(raw, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("t", F.lit(0.0)).alias("t"))
    rows = both.collect()
    s_all, t_all = sum(r.s for r in rows), sum(r.t for r in rows)
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = int(np.floor(1000 * np.log((r.t + 1) * (s_all + buckets) / ((r.s + 1) * (t_all + buckets)))))
    return out


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, nodes: int = NODES) -> DataFrame:
    """(id_col, n_words, n_features, weight): the sum of the gains of a text's features, on the paths of a trie that has the gain at each node."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)  # a number for each bucket
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator:
        release()
        trie, gained, table = Trie(), np.zeros(1, np.int64), shared.value
        for batch in batches:
            for a, b, data, offsets in buffers(batch.column(1)):
                n_words, paths = trie.walk(data, offsets, most)
                if len(trie) > len(gained):
                    gained = np.append(gained, table[np.array(trie.crc[len(gained) :], np.int64) % len(table)])
                weight, features = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for node, each in paths:
                    sums = np.append(0, np.cumsum(gained[node]))
                    ends = np.cumsum(each)
                    weight += sums[ends] - sums[ends - each]
                    features += each
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words.astype(np.int64)), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])
                if len(trie) > nodes:
                    trie, gained = Trie(), np.zeros(1, np.int64)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of the sha256 of '<seed>:<id>': noise that makes the highest scores a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", most: int = MOST, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, nodes: int = NODES) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (of the documents drawn, 1 the highest score; null of others).

    Features are the runs of 1 to `most` consecutive words (digits, letters and what lies beyond ASCII, A-Z lower-cased), repeats counted; a feature's bucket
    is the CRC of its text modulo `buckets`. Each partition counts in a trie of its own; bucket totals of docs and target are merged and give each bucket a
    gain, and documents are scored by walking a trie that has the gains at its nodes. Of the documents with at least `least_words` words, `share` in a hundred
    are drawn (rounded down): those of highest weight plus noise. Ties go to the smaller id; among rows that repeat an id and a score, any.
    Null and empty texts have no features, weight 0 and never a rank. Null ids all have the noise of an empty id and rank behind the others of their score.
    An empty target or an empty table is fine. Other columns are ignored, whatever their names.
    Ranks come from ranges of scores, so no task holds them all.
    """
    gain = gains(bucket_totals(docs, text_col, most, buckets, nodes), bucket_totals(target, target_text, most, buckets, nodes), buckets)
    rows = weighed(docs, gain, id_col, text_col, most, nodes)
    rows = rows.select(F.col(id_col).alias("id"), "n_features", "weight", (F.col("weight") + gumbel(F.col(id_col), seed)).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    placed = ahead(cut(rows, "weights"), [F.desc("may"), F.desc("score"), F.asc_nulls_last("id")])
    drawn = placed.agg(F.floor(F.count_if("may") * share / 100).alias("drawn"))
    drawn = drawn.head()[0] or 0
    rank = F.when(F.col("may") & (F.col("ahead") < drawn), F.col("ahead") + 1)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
