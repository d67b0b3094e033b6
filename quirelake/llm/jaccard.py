"""N-gram Jaccard join by prefix filtering, with the classes it makes.

A document is the set of its distinct 5-word shingles, each a 64-bit hash. Documents with equal sets are one node. Nodes whose sets overlap by 75 %
share a shingle among the first quarter of each, whatever total order shingles have; rare ones come first, so that common passages seldom meet. The order
is by a count sketch of fixed size over all documents, then by hash. Postings of prefixes are packed: a row per task and bucket, not per shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TABLE_FOLDED, Rolling, buffers, cut, cut_small, mix, release, row_key, words_in
from .graph import components

GRAM, PERCENT = 5, 75
#: Counters of the sketch (a byte each where it is broadcast), the bits of a hash that don't tell them, and the rows they travel in.
COUNTERS, BELOW, SLICES = 1 << 23, np.uint64(41), 64
#: Bytes of postings in a bucket, about; pairs of one node that one task verifies at most.
BUCKET_BYTES, SALTED = 6 << 20, 512
#: Ids up to which they are broadcast (8 bytes each).
BROADCAST_NODES = 1_000_000
#: Groups up to this size are paired in full at once; larger ones start from the pairs of a few nodes (HUBS), then those that are not yet linked are compared.
SMALL, HUBS = 3, 3
_POST = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<u4"), ("at", "<u4")])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a buffer."""
    starts, ends, before = words_in(data, offsets)
    h = Rolling(data, TABLE_FOLDED).ranges(starts, ends)
    counts = np.diff(before)
    full = np.zeros(max(0, len(h) - gram + 1), np.uint64)
    for j in range(gram):
        full = full * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : len(h) - gram + 1 + j] if len(full) else full
    full = mix(full)
    out = []
    for a, n in zip(before[:-1].tolist(), counts.tolist(), strict=True):
        if n >= gram:
            out.append(np.unique(full[a : a + n - gram + 1]))
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[a : a + n]:
                    short = short * np.uint64(0x9FB21C651E98DF25) + x
            out.append(mix(np.array([short])))
        else:
            out.append(full[:0])
    return out


def node_of(tokens: np.ndarray) -> int:
    """A hash of the whole set; equal sets give equal nodes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


def needed(size: np.ndarray | int, percent: int = PERCENT):
    """Least size of a partner, and of the overlap with one that is no larger: ceil(size * percent / 100)."""
    return -(-size * percent // 100)


def overlap(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b that link: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def _profiles(docs: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """A row (id, n, node) per document, and rows (slice, counts) of each task's sketch."""

    def run(batches) -> Iterator:
        sketch = np.zeros(COUNTERS, np.uint32)
        some = False
        for batch in batches:
            for a, b, data, offsets in buffers(batch.column(1)):
                sets = shingle_sets(data, offsets, gram)
                some = True
                np.add.at(sketch, (np.concatenate(sets) >> BELOW).astype(np.int64), np.uint32(1))
                n = [len(x) for x in sets]
                nodes = [node_of(x) if len(x) else None for x in sets]
                k = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if some:
            # What a task counts beyond 255 tells no more: the sketch only orders shingles.
            parts = np.array_split(np.minimum(sketch, 255).astype(np.uint8), SLICES)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names)

    names = ["id", "n", "node", "slice", "counts"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, node long, slice int, counts binary")


def _sketch(profiles: DataFrame) -> np.ndarray:
    """log2 of each counter's sum over all documents, a byte each: COUNTERS bytes."""

    def add(batches) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(c, np.uint8).astype(np.uint64)
                sums[s] = sums[s] + got if s in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.ceil(np.log2(x + np.uint64(1))).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], ["slice", "logs"])

    rows = profiles.filter("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, logs binary").collect()  # COUNTERS bytes in all
    return np.concatenate([np.frombuffer(r["logs"], np.uint8) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(COUNTERS, np.uint8)


def _groups(docs: DataFrame, text_col: str, gram: int, percent: int, logs: np.ndarray, buckets: int) -> DataFrame:
    """(key, n, members, tokens): sets of nodes that share prefix shingles of a bucket, as packed (node, size, at), sizes ascending; and how many they share.
    at is the place of the first of these shingles in the node's order."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def post(batches) -> Iterator:
        release()
        ranks = shared.value
        # Counters that all documents fill alike tell nothing; only those well above are held to be frequent.
        common = int(np.median(ranks)) + 2
        for batch in batches:
            for _, _, data, offsets in buffers(batch.column(0)):
                sets = [x for x in shingle_sets(data, offsets, gram) if len(x)]
                out = []
                for x in sets:
                    level = ranks[(x >> BELOW).astype(np.int64)]
                    order = np.lexsort((x, np.where(level < common, 0, level)))
                    size = len(x)
                    keep = size - needed(size, percent) + 1
                    rows = np.empty(keep, _POST)
                    rows["token"], rows["node"], rows["size"], rows["at"] = x[order[:keep]], node_of(x), size, np.arange(keep)
                    out.append(rows)
                if not out:
                    continue
                rows = np.concatenate(out)
                bucket = (rows["token"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*firsts[1:].tolist(), len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[firsts]), pa.array([rows[a:b].tobytes() for a, b in zip(firsts.tolist(), ends, strict=True)], pa.binary())], ["bucket", "rows"])

    def group(batches) -> Iterator:
        def of(parts: list[bytes]) -> Iterator:
            rows = np.frombuffer(b"".join(parts), _POST)
            rows = rows[np.lexsort((rows["node"], rows["size"], rows["token"]))]
            fresh = np.ones(len(rows), bool)  # equal sets post alike; each node once per shingle
            fresh[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
            rows = rows[fresh]
            starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
            ends = np.append(starts[1:], len(rows))
            size, at, node = rows["size"].astype(np.int64), rows["at"].astype(np.int64), rows["node"]
            # Pairs, all at once.
            a = starts[ends - starts == 2]
            pairs = np.stack([node[a], size[a], node[a + 1], size[a + 1]], axis=1)
            if len(a):
                pairs, back, counts = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
                least = np.full((len(pairs), 2), 1 << 40)
                np.minimum.at(least, back.ravel(), np.stack([at[a], at[a + 1]], axis=1))
                for x, y, n in zip(pairs, least, counts.tolist(), strict=True):
                    yield np.insert(x, [2, 4], y).reshape(2, 3), n
            larger: dict[bytes, list] = {}
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                members = np.stack([node[s:e], size[s:e], at[s:e]], axis=1)
                same = larger.setdefault(xxhash.xxh3_128_digest(node[s:e].tobytes()), [members, 0])
                np.minimum(same[0][:, 2], members[:, 2], out=same[0][:, 2])
                same[1] += 1
            for members, n in larger.values():
                for part in _by_length(members, percent):
                    yield part, n

        now, parts = None, []
        held: list[tuple[np.ndarray, int]] = []

        def flush():
            keys = [xxhash.xxh3_64_intdigest(m.tobytes(), now) - (1 << 63) for m, _ in held]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(m) for m, _ in held], pa.int32()), pa.array([n for _, n in held], pa.int64()), pa.array([m.astype("<i8").tobytes() for m, _ in held], pa.binary())], ["key", "n", "tokens", "members"])

        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    for m in of(parts) if parts else ():
                        held.append(m)
                        if len(held) >= 2000 or m[0].nbytes > 1 << 20:
                            yield flush()
                            held.clear()
                    now, parts = bucket, []
                parts.append(rows)
        for m in of(parts) if parts else ():
            held.append(m)
            if len(held) >= 2000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    packed = docs.select(F.col(text_col)).mapInArrow(post, "bucket int, rows binary")
    found = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(group, "key long, n int, tokens long, members binary")
    return cut(found, "groups")


def _by_length(members: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Length filter: a run of ascending sizes is cut where no later member can match any earlier one."""
    size = members[:, 1]
    cuts = np.flatnonzero(100 * size[:-1] < percent * size[1:]) + 1
    for part in np.split(members, cuts):
        if len(part) > 1:
            yield part


def _members(groups: DataFrame) -> DataFrame:
    """(key, tokens, node, size, at) of larger groups, and central: how many prefix shingles a node shares in all of them."""

    def spread(batches) -> Iterator:
        for batch in batches:
            for key, tokens, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.frombuffer(data, "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), key)), pa.array(np.full(len(m), tokens)), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(3))], ["key", "tokens", "node", "size", "at"])

    rows = cut(groups.filter(F.col("n") > SMALL).select("key", "tokens", "members").mapInArrow(spread, "key long, tokens long, node long, size long, at long"), "members")
    return cut(rows.join(rows.groupBy("node").agg(F.sum("tokens").alias("central")), "node"), "members")


def _pairs(groups: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b, need, shared) of small groups with what they share there; and those that may link, with others (a, b): of larger groups each member
    with the HUBS members that share most with all, which are likeliest to link.

    Positional filter: the first shingle that two linking sets share lies so early in both that enough of each is left (first). Over the whole prefix: sets that link share at least overlap - (size - prefix length of the larger) shingles in their prefixes. What a
    pair shares is counted in small groups; in larger ones it is at most what either node has there."""

    def run(batches) -> Iterator:
        for batch in batches:
            got: list[np.ndarray] = []
            for data, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(data, "<i8").reshape(-1, 3)
                i, j = np.triu_indices(len(m), 1)
                swap = m[i, 0] > m[j, 0]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                lo, hi = np.minimum(m[i, 1], m[j, 1]), np.maximum(m[i, 1], m[j, 1])
                ok = 100 * lo >= percent * hi
                both = overlap(lo, hi, percent)
                first = (m[i, 2] <= m[i, 1] - both) & (m[j, 2] <= m[j, 1] - both)
                got.append(np.stack([m[i, 0], m[j, 0], both - needed(hi, percent) + 1, np.full(len(i), tokens), first], axis=1)[ok])
            if got:
                rows = np.concatenate(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)], ["a", "b", "need", "shared", "first"])

    small = groups.filter(F.col("n") <= SMALL).select("members", "tokens").mapInArrow(run, "a long, b long, need long, shared long, first long")
    found = cut(small.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("shared").alias("shared"), F.max("first").alias("first")), "candidates")
    best = F.slice(F.sort_array(F.collect_set(F.struct("central", "node", "size", "at")), asc=False), 1, HUBS)
    # The best of a group from the best of its parts: partial sums keep a row of each.
    part = members.groupBy("key", F.pmod("node", F.lit(64)).alias("part")).agg(F.max(F.struct("central", "node", "size", "at")).alias("top"))
    hubs = part.select("key", "top.*").groupBy("key").agg(best.alias("hubs"))
    stars = members.join(hubs, "key").select("node", "size", "at", "central", F.explode("hubs").alias("h")).filter("node <> h.node")
    lo, hi = F.least("size", "h.size"), F.greatest("size", "h.size")
    up = lambda x, by: -F.floor(-(x) / by)
    both = up(percent * (lo + hi), 100 + percent)
    stars = stars.filter((100 * lo >= percent * hi) & (F.col("at") <= F.col("size") - both) & (F.col("h.at") <= F.col("h.size") - both))
    stars = stars.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"), (both - up(hi * percent, 100) + 1).cast("long").alias("need"), F.least("central", "h.central").alias("most")).distinct()
    return found, _enough(stars, found).union(_within(found, members)).distinct()


def _enough(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b, need, most) of larger groups that may share enough, counting what they share in small ones."""
    return pairs.join(found.select("a", "b", "shared"), ["a", "b"], "left").filter(F.coalesce("shared", F.lit(0)) + F.col("most") >= F.col("need")).select("a", "b")


def _within(found: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of small groups that may share enough, counting what they may share in larger ones."""
    more = cut_small(members.select("node", "central").distinct(), "in-larger")
    early = found.filter(F.col("first") == 1)
    unsure = early.filter("shared < need")
    for k in ("a", "b"):
        unsure = unsure.join(more.select(F.col("node").alias(k), F.col("central").alias(f"more_{k}")), k)
    unsure = unsure.filter(F.col("shared") + F.least("more_a", "more_b") >= F.col("need"))
    return early.filter("shared >= need").select("a", "b").union(unsure.select("a", "b"))


def _cross_pairs(members: DataFrame, candidates: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of larger groups' members whose components differ so far (members of one component need no more pairs), whose first common shingle may be among
    those of the group, and that may share enough."""
    known = members.join(labels, "node", "left").select("key", "node", "size", "at", "central", F.coalesce("component", "node").alias("label"))
    known = cut(known, "labelled")
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")

    def cross(batches) -> Iterator:
        def of(m: np.ndarray) -> Iterator:
            m = m[np.argsort(m[:, 2], kind="stable")]
            low = np.searchsorted(m[:, 2], needed(m[:, 2], percent))
            for j in range(1, len(m)):  # members ascending by size, each with those before it that are long enough and elsewhere
                before = m[low[j] : j]
                both = overlap(before[:, 2], m[j, 2], percent)
                good = (before[:, 5] != m[j, 5]) & (before[:, 3] <= before[:, 2] - both) & (m[j, 3] <= m[j, 2] - both)
                if good.any():
                    before, both = before[good], both[good]
                    yield np.stack([np.minimum(before[:, 1], m[j, 1]), np.maximum(before[:, 1], m[j, 1]), both - needed(m[j, 2], percent) + 1, np.minimum(before[:, 4], m[j, 4])], axis=1)

        def out(got: list[np.ndarray]):
            rows = np.unique(np.concatenate(got), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["a", "b", "need", "most"])

        key, held, got, n = None, [], [], 0

        def close():
            nonlocal got, n
            for p in of(np.concatenate(held)) if held else ():
                got.append(p)
                n += len(p)
                if n > 500_000:
                    yield out(got)
                    got, n = [], 0

        for batch in batches:
            table = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            firsts = np.flatnonzero(np.append(True, table[1:, 0] != table[:-1, 0])) if len(table) else []
            for x in np.split(table, firsts[1:]) if len(table) else ():
                if x[0, 0] != key:
                    yield from close()
                    key, held = x[0, 0], []
                held.append(x)
        yield from close()
        if got:
            yield out(got)

    dealt = known.join(mixed, "key", "left_semi").repartition("key").sortWithinPartitions("key")
    found = dealt.select("key", "node", "size", "at", "central", "label").mapInArrow(cross, "a long, b long, need long, most long").distinct()
    return _enough(found, candidates)


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, gram: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets link. Each pair is compared once; sets are made where their texts lie and go straight to the tasks that compare them:
    b's to their pairs, a's once to each task."""
    # A node with many pairs is dealt to several tasks.
    per_node = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    parts = F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("n") / SALTED), F.lit(1)))
    dealt = cut(pairs.join(per_node, "a").select("a", "b", parts.cast("int").alias("salt")), "dealt")
    to = F.struct("a", "salt")
    wanted = dealt.select(F.col("b").alias("node"), to.alias("to")).union(dealt.select(F.col("a").alias("node"), to.alias("to")).distinct())
    wanted = wanted.groupBy("node").agg(F.collect_list("to").alias("to"))
    chosen = nodes.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).join(wanted, "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(cut_small(chosen, "chosen"), "id").select("node", "text", "to")

    def sets(batches) -> Iterator:
        for batch in batches:
            for first, last, data, offsets in buffers(batch.column(1)):
                rows, held = [], 0
                for tokens, node, to in zip(shingle_sets(data, offsets, gram), batch.column(0).slice(first, last - first).to_pylist(), batch.column(2).slice(first, last - first).to_pylist(), strict=True):
                    if len(tokens) and node_of(tokens) == node:  # rows that repeat an id may hold other texts
                        packed = tokens.tobytes()
                        rows += [(x["a"], x["salt"], None if x["a"] == node else node, packed) for x in to]
                        held += len(packed) * len(to)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "salt", "b", "tokens"])

    def check(batches) -> Iterator:
        key, own = None, None
        for batch in batches:
            good = []
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b is None:
                    key, own = a, np.frombuffer(t, np.uint64)
                    continue
                if a == key and _linked(own, np.frombuffer(t, np.uint64), percent):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    both = texts.mapInArrow(sets, "a long, salt int, b long, tokens binary").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(check, "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Suffix filter, then the overlap itself. Both sorted."""
    need = overlap(len(x), len(y), percent)
    most = len(x) + len(y) - 2 * need  # elements that may be in one only
    # Suffix filter: parts of both sets between common bounds differ at least by their sizes.
    bounds = y[len(y) // 4 :: max(1, len(y) // 4)][:3]
    cx, cy = np.diff(np.searchsorted(x, bounds), prepend=0, append=len(x)), np.diff(np.searchsorted(y, bounds), prepend=0, append=len(y))
    if np.abs(cx[:-1] - cy[:-1]).sum() + abs((len(x) - cx[:-1].sum()) - (len(y) - cy[:-1].sum())) > most:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach, its own included).

    Words are runs without white space (space and \\x09-\\x0D), A-Z lower-cased; a text of fewer than `gram` words is one shingle, one without words
    (null, empty, blank) has none and links with nothing. Documents with equal sets always link. Two sets link when 100 * overlap >= percent * union.
    Rows with a null id take part and form links, but never name a class unless all its ids are null. Repeated rows each give a row. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    if not docs.filter(F.col(id_col).isNull()).isEmpty():  # an id names no row then
        rows = jaccard_classes(docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")), "row", "text", gram, percent)
        return rows.select(F.col("row.id").alias(id_col), "n_shingles", F.col("component_id.id").alias("component_id"))
    profiles = cut(_profiles(docs, id_col, text_col, gram), "profiles")
    members = profiles.filter("slice IS NULL").select("id", "n", "node")
    nodes = members.filter("node IS NOT NULL").select("id", "node")
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    buckets = max(8, -(-total * (100 - percent) // 100 * _POST.itemsize // BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = _groups(docs, text_col, gram, percent, _sketch(profiles), buckets)
    larger = _members(groups)
    candidates, first = _pairs(groups, larger, percent)
    first = cut(first, "pairs")
    links = cut(verify(first, docs, nodes, id_col, text_col, gram, percent), "links")
    labels = cut(components(links), "labels")
    second = cut(_cross_pairs(larger, candidates, labels, percent).join(first, ["a", "b"], "left_anti"), "cross-pairs")
    if not second.isEmpty():
        more = cut(verify(second, docs, nodes, id_col, text_col, gram, percent), "more-links")
        if not more.isEmpty():
            labels = cut(components(links.union(more)), "labels")
    # Classes by node, then the least document of each class: sums before shuffles, so groups of copies never meet in one task.
    least = nodes.groupBy("node").agg(F.min("id").alias("least"))
    classed = least.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "least")
    classed = cut(classed, "classed")
    names = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classed.join(names, "class").select("node", "component_id")
    return members.join(named, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
