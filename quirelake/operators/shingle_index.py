"""A stored index of shingles: uploads are matched with the documents in it, and only what they touch is read.

A folder of two Parquet tables. postings (batch, bucket, h, kind, document_id): for a hash, the documents that have it; bucket is h modulo BUCKETS. kind: SHINGLE, FIRST
(a shingle among as many as a document can't all lack in one that holds enough of it), PRINT (fingerprint), TITLE. heads (batch, slot, ...): a document's source,
title, fingerprint, number of shingles, status, and the batch with its postings; the row of the latest batch holds. Batches are folders, so a batch that runs again
replaces itself. A shingle is stored once, in the postings.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..shared import exists, small, written
from .duplicates import ROUNDING, _packed, classify, shingle_hashes

SHINGLE, FIRST, PRINT, TITLE = range(4)
BUCKETS = 64
#: Counters of the sketch that tells how frequent a shingle is, and the bits of a hash that don't name one; rows they travel in.
COUNTERS, BELOW, SLICES = 1 << 21, 43, 16
#: Postings that a task unpacks at a time, about; a shingle with more than a quarter of them is dealt out by document.
PART = 3_000_000
#: Sorted hashes are stored as differences.
LAYOUT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def _sets(docs: DataFrame, n: int) -> DataFrame:
    status = F.col("status") if "status" in docs.columns else F.lit("active")
    return docs.select("document_id", "source_file", T.normalise_title(F.col("title")).alias("t"), "fingerprint", F.array_sort(shingle_hashes(F.col("text"), n)).alias("hs"), status.alias("status"))


def _names(rows: DataFrame) -> DataFrame:
    """(document_id, h, kind) of fingerprints and titles."""
    name = lambda kind, c: F.struct(F.xxhash64(F.lit(kind), c).alias("h"), F.lit(kind).alias("kind"))
    both = F.array(name(PRINT, F.col("fingerprint")), F.when(F.col("t") != "", name(TITLE, F.col("t"))))
    return rows.select("document_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("document_id", "x.h", "x.kind")


def _firsts(rows: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(document_id, h, first): a document's shingles; first are the rarest, so many that one that lacks them all holds less than `least` of the document."""
    each = rows.select("document_id", F.size("hs").alias("n"), F.explode("hs").alias("h")).join(counts, "h", "left")
    lists = each.groupBy("document_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h"))).alias("s"))
    most = F.col("n") + 1 - F.ceil(F.col("n") * (least - ROUNDING) - 1e-9).cast("int")
    return lists.select("document_id", F.posexplode("s").alias("i", "x"), most.alias("most")).select("document_id", "x.h", (F.col("i") < F.col("most")).alias("first"))


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _counter(hs: np.ndarray) -> np.ndarray:
    return (hs.astype(np.int64).view(np.uint64) >> np.uint64(BELOW)).astype(np.int64)


def _flat(lists: pa.Array) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches):
    """A task's sketch as rows (slice, counts). What a task counts beyond 255 tells no more: the sketch only orders shingles."""
    sketch = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        np.add.at(sketch, _counter(_flat(batch.column(0))), np.uint32(1))
    parts = np.split(np.minimum(sketch, 255).astype(np.uint8), SLICES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // SLICES, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.uint8)
    return pa.table({"slice": table.column("slice").slice(0, 1), "logs": pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})


def _sketch(rows: DataFrame) -> np.ndarray:
    """log2 of how many documents fill each counter: a byte each, COUNTERS bytes whatever the size of the table."""
    found = rows.select("hs").mapInArrow(_counted, "slice int, counts binary").groupBy("slice").applyInArrow(_summed, "slice int, logs binary").collect()
    return np.concatenate([np.frombuffer(r["logs"], np.uint8) for r in sorted(found, key=lambda r: r["slice"])]) if found else np.zeros(COUNTERS, np.uint8)


def _posted(ids: pa.Array, hs: np.ndarray, n: np.ndarray, buckets: int, parts: int, logs: np.ndarray, least: float):
    """A row per bucket and part of it: (bucket, part, ids, hashes in order as differences by byte planes, documents' places, bits of those that are first).

    First are a document's rarest shingles by the sketch, so many that one that lacks them all holds less than `least` of the document; which they are
    only decides what is looked at, not what is found."""
    if not len(hs):
        return
    h, at = hs.astype(np.int64), np.repeat(np.arange(len(n)), n)
    rare = np.argsort(at << 8 | logs[_counter(h)], kind="stable")
    most = n + 1 - np.ceil(n * (least - ROUNDING) - 1e-9).astype(np.int64)
    first = np.empty(len(h), bool)
    first[rare] = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(most, n)
    part = (h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    part = np.where(2.0 ** logs[_counter(h)] > PART / 4, at % parts, part.astype(np.int64))
    own = np.mod(h, buckets) * parts + part
    order = np.lexsort((h.view(np.uint64), own))
    own, h, at, first = own[order], h.view(np.uint64)[order], at[order], first[order]
    cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        docs, place = np.unique(at[lo:hi], return_inverse=True)
        steps = np.diff(h[lo:hi], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        rows.append((int(own[lo] // parts), int(own[lo] % parts), docs, np.ascontiguousarray(steps).tobytes(), place.astype(np.uint16).tobytes(), np.packbits(first[lo:hi]).tobytes()))
    k, p, docs, steps, place, marks = zip(*rows)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, docs)]), pa.int32()), ids.take(pa.array(np.concatenate(docs))))
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), lists, *[pa.array(x, pa.binary()) for x in (steps, place, marks)]], ["bucket", "part", "ids", "h", "at", "first"])


def _unpacked(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """(bucket, h, kind, document_id) of a part's packed postings."""
    hs, at, kinds, before = [], [], [], 0
    for h, place, marks, own in zip(table.column("h"), table.column("at"), table.column("first"), table.column("ids")):
        steps = np.frombuffer(h.as_buffer(), np.uint8).reshape(8, -1)
        hs.append(np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64))
        at.append(np.frombuffer(place.as_buffer(), np.uint16).astype(np.int64) + before)
        kinds.append(np.where(np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8), count=len(hs[-1])), FIRST, SHINGLE).astype(np.int32))
        before += len(own)
    h = np.concatenate(hs).view(np.int64)
    bucket_ = np.full(len(h), table.column("bucket")[0].as_py(), np.int32)
    return pa.table([bucket_, h, np.concatenate(kinds), pc.list_flatten(table.column("ids")).take(pa.array(np.concatenate(at)))], schema.names).cast(schema)


def _postings(rows: DataFrame, least: float, buckets: int) -> DataFrame:
    """(bucket, h, kind, document_id) of documents' shingles, which are shuffled once, packed: a row per part of a bucket and lot of documents."""
    logs = rows.sparkSession.sparkContext.broadcast(_sketch(rows))
    parts = max(-(-(rows.agg(F.sum(F.size("hs"))).first()[0] or 0) // (buckets * PART)), 1)
    kind = rows.schema["document_id"].dataType
    packed = StructType([StructField("bucket", IntegerType()), StructField("part", IntegerType()), StructField("ids", ArrayType(kind)), *[StructField(c, BinaryType()) for c in ("h", "at", "first")]])
    out = StructType([StructField("bucket", IntegerType()), StructField("h", LongType()), StructField("kind", IntegerType()), StructField("document_id", kind)])
    lot = lambda ids, hs, n, k: _posted(ids, hs, n, k, parts, logs.value, least)
    unpack = functools.partial(_unpacked, schema=to_arrow_schema(out))
    return rows.select("document_id", "hs").mapInArrow(lambda batches: _packed(batches, buckets, lot), packed).groupBy("bucket", "part").applyInArrow(lambda table: unpack(table), out)


def add(docs: DataFrame, at: str, batch: int, least: float = 0.6, n: int = 5, buckets: int = BUCKETS) -> None:
    """Adds documents (document_id, source_file, title, text, fingerprint, and status if known) as a batch; a document that is there already gets a new head.

    Sets are written once and shuffled once, packed, to parts of buckets; a shingle that most documents have is dealt out over the parts of its bucket, so it is
    no large task."""
    rows = written(_sets(docs, n), "index-sets")
    to = f"{at}/postings/batch={batch}"
    _postings(rows, least, buckets).sortWithinPartitions("bucket", "h").write.options(**LAYOUT).partitionBy("bucket").mode("overwrite").parquet(to)
    names = _names(rows).withColumn("bucket", bucket(F.col("h"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "h")
    names.select("bucket", "h", "kind", "document_id").write.options(**LAYOUT).partitionBy("bucket").mode("append").parquet(to)
    set_heads(rows.select("document_id", "source_file", "t", "fingerprint", F.size("hs").alias("n"), "status", F.lit(batch).alias("since")), at, batch, buckets)


def set_heads(rows: DataFrame, at: str, batch: int, buckets: int = BUCKETS) -> None:
    """Writes heads of documents; a batch without postings changes their status alone."""
    slots = rows.withColumn("slot", bucket(F.xxhash64("document_id"), buckets))
    slots.repartition("slot").write.partitionBy("slot").mode("overwrite").parquet(f"{at}/heads/batch={batch}")


def _read(spark: SparkSession, at: str, table: str, before: int | None, within: DataFrame, column: str) -> DataFrame:
    """The rows of earlier batches in those buckets that `within` names (at most as many as there are buckets)."""
    rows = spark.read.parquet(f"{at}/{table}")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.filter(F.col(column).isin([r[0] for r in within.distinct().collect()]))


def retire(ids: DataFrame, at: str, batch: int, buckets: int = BUCKETS) -> None:
    """Documents (document_id) that were superseded: found no more from this batch on."""
    rows = heads(ids, at, batch, buckets).withColumn("status", F.lit("superseded"))
    set_heads(written(rows, "retired"), at, batch, buckets)


def heads(ids: DataFrame, at: str, before: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The latest head of each of the documents (document_id)."""
    ids = ids.select("document_id").distinct().withColumn("slot", bucket(F.xxhash64("document_id"), buckets))
    rows = _read(ids.sparkSession, at, "heads", before, ids.select("slot"), "slot").join(ids, ["slot", "document_id"], "left_semi")
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("source_file", "t", "fingerprint", "n", "status", "since"), "batch").alias("x"))
    return last.select("document_id", "x.*")


def candidates(new: DataFrame, at: str, before: int | None = None, jaccard: float = 0.6, containment: float = 0.75, n: int = 5, buckets: int = BUCKETS, titles: bool = True) -> DataFrame:
    """(a, b, jaccard, a_in_b, b_in_a, reasons): what upload_candidates tells of uploads and the active documents in the index (of batches before `before`).

    Two texts are near if one holds enough of the other's shingles. If b holds enough of a, it has one of a's rarest; if a holds enough of b, it has one of b's
    first. So a's rarest meet all postings and all of a's meet first postings; of each pair found, all shared shingles are then counted. Read are the
    buckets of the uploads' hashes, once, and the heads of what was found."""
    spark = new.sparkSession
    a = written(_sets(new, n), "uploads")
    if not exists(spark, f"{at}/postings"):
        return _reported(a.limit(0).select(F.col("document_id").alias("a"), F.col("document_id").alias("b"), *[F.lit(0.0).alias(c) for c in ("jaccard", "a_in_b", "b_in_a")], F.lit(False).alias("same"), F.lit(False).alias("title")), jaccard, containment)
    keys = written(a.select("document_id", F.explode("hs").alias("h"), F.lit(SHINGLE).alias("kind")).unionByName(_names(a)), "upload-keys")
    posted = _read(spark, at, "postings", before, keys.select(bucket(F.col("h"), buckets)), "bucket").select("h", "kind", F.col("document_id").alias("b"), "batch")
    posted = written(posted.join(small(keys.select("h").distinct(), "upload-hashes"), "h", "left_semi"), "upload-postings")
    counts = posted.filter(F.col("kind") <= FIRST).groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    rare = _firsts(a, counts, min(jaccard, containment)).filter("first").select(F.col("document_id").alias("a"), "h")
    every = small(keys.filter(F.col("kind") == SHINGLE).select(F.col("document_id").alias("a"), "h"), "shingles")
    names = keys.filter((F.col("kind") == PRINT) | ((F.col("kind") == TITLE) & F.lit(titles))).select(F.col("document_id").alias("a"), "h", "kind")
    found = posted.filter(F.col("kind") <= FIRST).join(small(rare, "rare"), "h").select("a", "b")
    found = found.unionByName(posted.filter(F.col("kind") == FIRST).join(every, "h").select("a", "b"))
    found = written(found.unionByName(posted.join(small(names, "names"), ["h", "kind"]).select("a", "b")).distinct(), "found")
    b = written(heads(found.select(F.col("b").alias("document_id")), at, before, buckets).filter("status = 'active'"), "found-heads")
    # Only the postings of the batch that a head speaks of: a document that came again may have lost some.
    alive = small(b.select(F.col("document_id").alias("b"), F.col("since").alias("batch")), "alive")
    met = posted.filter(F.col("kind") <= FIRST).join(alive, ["b", "batch"], "left_semi").select("h", "b").join(every, "h").join(small(found, "pairs"), ["a", "b"], "left_semi")
    met = met.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    side = lambda df, k: df.select(F.col("document_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("source_file", "t", "fingerprint", "n")])
    both = found.join(side(a.withColumn("n", F.size("hs")), "a"), "a").join(side(b, "b"), "b").filter("source_file_a <> source_file_b")
    both = both.join(met, ["a", "b"], "left")
    na, nb, m = F.col("n_a"), F.col("n_b"), F.coalesce("m", F.lit(0))
    ratio = lambda of: F.coalesce(F.round(m / F.nullif(of, F.lit(0)), 4), F.lit(0.0))
    both = both.select("a", "b", ratio(na + nb - m).alias("jaccard"), ratio(na).alias("a_in_b"), ratio(nb).alias("b_in_a"), (F.col("fingerprint_a") == F.col("fingerprint_b")).alias("same"), ((F.col("t_a") == F.col("t_b")) & (F.col("t_a") != "") & F.lit(titles)).alias("title"))
    return _reported(both, jaccard, containment)


def _reported(both: DataFrame, jaccard: float, containment: float) -> DataFrame:
    reasons = classify(F.col("same"), F.col("jaccard"), F.col("a_in_b"), F.col("b_in_a"), F.col("title"), jaccard, containment)
    return both.select("a", "b", "jaccard", "a_in_b", "b_in_a", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def watch(uploads: DataFrame, at: str, to: str, checkpoint: str, **options):
    """A stream of uploads (document_id, source_file, title, text, fingerprint): of each batch, candidates among what earlier batches brought go to `to`, then the batch
    is added. A batch that runs again gives the same."""

    def batch(df: DataFrame, nth: int) -> None:
        new = written(df, "upload-batch")
        candidates(new, at, nth, **options).write.mode("overwrite").parquet(f"{to}/batch={nth}")
        add(new, at, nth)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
