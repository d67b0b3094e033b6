"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, TABLE_FOLDED, Rolling, buffers, cut, mix, words_in

#: Hash space of features; labelled rows that the model is fitted on at most (those with the least hash of their id, whatever the input's size).
BITS, TRAIN_ROWS, EPOCHS = 22, 12_000, 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
#: Weight of toxic examples: the share of the others to theirs, but no more than this.
MOST_WEIGHT = 2.0
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, row) of each feature of each row of a buffer, repeats included: words, pairs, and pairs around one word; A-Z lower-cased."""
    starts, ends, before = words_in(data, offsets, ALNUM)
    h = Rolling(data, TABLE_FOLDED).ranges(starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    shift = np.uint64(64 - bits)
    index, rows = [h >> shift], [row]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93)):
        same = row[gap:] == row[:-gap]
        index.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]) >> shift)
        rows.append(row[gap:][same])
    return np.concatenate(index).astype(np.int64), np.concatenate(rows)


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """Indexes and values of the weights that are not 0, and the bias. Examples: (distinct indexes, label), in the order to learn them."""
    z, n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    zb = nb = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, np.float32(0), (np.sign(z) * np.float32(l1) - z) / ((beta + np.sqrt(n)) / np.float32(alpha) + np.float32(l2)))

    toxic = sum(label for _, label in examples)
    heavier = min(MOST_WEIGHT, max(1.0, (len(examples) - toxic) / max(toxic, 1)))
    for _ in range(epochs):
        for index, label in examples:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            bias = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(float(w.sum()) + bias, -30, 30)))
            g = (p - label) * (heavier if label else 1.0)
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return kept, weights(z[kept], n[kept]), -zb / ((beta + nb**0.5) / alpha)


def calibrated(examples: list[tuple[np.ndarray, int]], bits: int = BITS, least: int = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """Like ftrl, with the bias moved so that scores pass THRESHOLD where it parts labels best: a model of three quarters of the examples is asked for the
    fourth (if that has `least` toxic ones), and the bias goes half way towards the margin with the best F-measure there, precision counting double (half, as clean documents are to be left alone)."""
    index, value, bias = ftrl(examples, bits)
    asked = examples[::4]
    toxic = sum(label for _, label in asked)
    if toxic < least or toxic == len(asked):
        return index, value, bias
    i, v, b = ftrl([x for k, x in enumerate(examples) if k % 4], bits)
    table = np.zeros(1 << bits, np.float32)
    table[i] = v
    margin = np.array([b + float(table[x].sum()) for x, _ in asked])
    label = np.array([y for _, y in asked])
    order = np.argsort(-margin, kind="stable")
    margin, label = margin[order], label[order]
    f = 1.25 * np.cumsum(label) / (0.25 * toxic + np.arange(1, len(asked) + 1))
    best = np.flatnonzero(f >= f.max() - 1e-12)
    k = int(best[len(best) // 2])
    cut_at = (margin[k] + margin[min(k + 1, len(margin) - 1)]) / 2
    return index, value, bias + float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut_at) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (indexes, values, bias) from at most `rows` labelled documents that are not held out.

    An id with several labels counts as its largest; null ids and labels are ignored. Features are made where the documents lie; only their
    hashes meet, in one task, which has at most `rows` documents. Without examples the weights are empty and the bias 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    # Only ids that name a document count towards the bound.
    known = known.filter(~held_out(F.col("id"))).join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").groupBy("id").agg(F.max("label").alias("label"))
    sample = F.broadcast(known.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(rows))  # at most `rows` ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")

    def extract(batches):
        for batch in batches:
            for a, b, data, offsets in buffers(batch.column(0)):
                index, row = features(data, offsets, bits)
                order = np.argsort(row, kind="stable")
                index = index[order]
                ends = np.searchsorted(row[order], np.arange(b - a), "right")
                got = [np.unique(index[x:y]).astype("<i4").tobytes() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), *(c.slice(a, b - a) for c in batch.columns[1:])], ["features", "label", "nth"])

    made = texts.select("text", "label", F.xxhash64(F.lit(2), "id", "text").alias("nth")).mapInArrow(extract, "features binary, label int, nth long")

    def learn(batches):
        examples = [(np.frombuffer(f, "<i4"), y) for batch in batches for f, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        index, value, bias = calibrated(examples, bits) if examples else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.append(index, -1), pa.int64()), (np.append(value, bias).astype(float), pa.float64()))], ["index", "value"])

    got = made.repartition(1).sortWithinPartitions("nth", "label").mapInArrow(learn, "index long, value double").collect()  # at most 2**bits weights, few by L1
    got = sorted((r[0], r[1]) for r in got)
    return np.array([r[0] for r in got if r[0] >= 0], np.int64), np.array([r[1] for r in got if r[0] >= 0]), next((r[1] for r in got if r[0] < 0), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score", bits: int = BITS) -> DataFrame:
    """docs with the column score, 0 to 1: how likely the whole text is toxic. Null, empty and wordless texts score as the bias alone."""
    index, value, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((index, value))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        known, weights = shared.value
        out = np.full(len(texts), float(bias))
        for a, b, data, offsets in buffers(texts):
            if not len(known) or not len(data):
                continue
            table = _hit_table(known, bits)
            i, row = features(data, offsets, bits)
            hit = table[i]
            both = np.unique(row[hit] << bits | i[hit])
            out[a:b] += np.bincount(both >> bits, weights[np.searchsorted(known, both & ((1 << bits) - 1))], b - a)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn(score_col, scored(F.col(text_col)))


_tables: dict = {}


def _hit_table(known: np.ndarray, bits: int) -> np.ndarray:
    key = (bits, known.tobytes())
    if key not in _tables:
        _tables.clear()
        _tables[key] = np.zeros(1 << bits, bool)
        _tables[key][known] = True
    return _tables[key]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= threshold).

    held_out: crc32 of the id as text leaves 1 modulo 3 (false for null ids); labels of such rows are never learnt. Scores come from whole
    texts alone. Repeated rows each get the same score. Without labels all scores are 0.5. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return score(base, model, "_text").select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
