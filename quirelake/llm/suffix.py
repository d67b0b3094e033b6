"""Repeated byte strings, by suffix arrays and threshold-bounded interval expansion.

A string of `least` bytes that occurs twice has the same least gram hash in both places, at the same offset. So windows of `least` bytes are dealt out by
that anchor: consecutive windows with one anchor form a run, and only runs of one anchor can share a window. Runs that are equal as a whole are settled
by their digests. Runs that share an anchor but differ are compared by the method: a suffix array of their texts, its Burrows-Wheeler transform, and
breadth-first backward extension of intervals, which finds common prefixes by increasing length and stops at `least`; what has no shorter
common prefix with its neighbour by then repeats.

Beside that, repeated passages that are too short to be removed are counted by fingerprints of their words (see repeated_passages).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, TABLE_FOLDED, Rolling, buffers, cut, cut_small, minima, release, words_in

LEAST, GRAM = 400, 96
#: Runs of one anchor beyond which they are dealt out by their inner parts; windows of such a part.
CROWD, STRIDE = 256, 64
#: Bytes of text of a suffix array, about.
BATCH_BYTES = 1_900_000
#: Words of a fingerprint, and of the passages that are sure to hold one.
WORDS, PASSAGE = 32, 50
_LOW = np.uint64(0xFFFFFFFF)


def runs(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a buffer: anchor hash, anchor place, first window and number of windows of each run, in order. Places count from the buffer's start.

    The anchor of a window is its gram with the least hash, the last of equals; which one it is depends on the window's bytes alone.
    """
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(data) < least:
        return none
    h = Rolling(data).windows(gram)
    width = least - gram + 1
    place = np.arange(len(h), dtype=np.uint64)
    key = (h & ~_LOW) | (_LOW - place)
    n = len(data) - least + 1
    at = (_LOW - (minima(key, width) & _LOW)).astype(np.int64)
    # Windows that cross from one row into the next don't count.
    inside = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= least:
            inside[a : b - least + 1] = True
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(at[1:], at[:-1], out=fresh[1:])
    fresh[1:] |= ~inside[:-1]
    edges = offsets[1:-1]
    fresh[edges[edges < n]] = True
    fresh &= inside
    first = np.flatnonzero(fresh)
    # A run ends where the next begins or its row's windows end.
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], n), offsets[row + 1] - least + 1)
    return h[at[first]], at[first], first, last - first


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text ordered by their first `depth` bytes at least: by 8 bytes, then prefix tripling of those whose order is open (doubling, where three
    ranks don't fit 63 bits)."""
    n = len(text)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
    # A suffix's rank is the place of the first of its equals; open ones share it with others.
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    shared = ~(fresh & np.append(fresh[1:], True))
    slots = np.flatnonzero(shared)
    length = 8
    times = 3 if n < 1 << 21 else 2
    while length < depth and len(slots):
        at = order[slots]
        key = place = rank[at]
        for k in range(1, times):
            key = key * (n + 1) + rank[np.minimum(at + k * length, n)]
        sort = np.argsort(key)
        at, key, place = at[sort], key[sort], place[sort]
        order[slots] = at  # slots ascend as places do
        fresh = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        length *= times
    return order


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix by rank: whether it shares `least` bytes with the one before. Bytes 0 end texts; no prefix passes them.

    Breadth-first over intervals of the suffix array: an interval of strings w, extended by the characters before them in the Burrows-Wheeler
    transform, gives those of cw. The end of an interval that is met for the first time at length l has common prefix l - 1 with its successor. After
    `least` steps the ends not met have a longer one.
    """
    n = len(text)
    before = text[order - 1]  # the transform
    before[order == 0] = 0
    # LF mapping: the k-th c of the transform is the k-th suffix that starts with c.
    by_char = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_char] = np.arange(n)
    if (text[order[0]] != 0) or not n:
        raise ValueError("texts must be ended by 0")
    met = np.zeros(n + 1, bool)  # met[i]: rank i and i - 1 part before `least`
    met[0] = met[n] = True
    ends = int(np.searchsorted(text[order], 1))  # ranks of the ends: each is a string of its own
    met[: ends + 1] = True
    counts = np.bincount(text, minlength=256)
    starts = np.cumsum(counts) - counts
    lo, hi = [np.arange(ends)], [np.arange(ends)]
    for c in np.flatnonzero(counts[1:]) + 1:
        met[starts[c]] = True
        lo.append(np.array([starts[c]]))
        hi.append(np.array([starts[c] + counts[c] - 1]))
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    span = 1 << n.bit_length()
    # Intervals so far are of strings of 1 byte: their ends have a common prefix of 0 bytes with what follows.
    for _ in range(1, least):
        if not len(lo):
            break
        lens = hi - lo + 1
        one = lens == 1
        # Single suffixes: one character goes before.
        a = lo[one]
        a = a[before[a] > 0]
        p = lf[a]
        p = p[~met[p + 1]]
        # Wider ones: the first and last suffix of each character in the interval.
        wide, wlens = lo[~one], lens[~one]
        total = int(wlens.sum())
        if total:
            group = np.repeat(np.arange(len(wide)), wlens)
            idx = np.arange(total) - np.repeat(np.cumsum(wlens) - wlens, wlens) + np.repeat(wide, wlens)
            tag = np.sort((group * 256 + before[idx]) * span + idx)  # by interval, character, rank
            idx, tag = tag & (span - 1), tag >> n.bit_length()
            edge = np.flatnonzero(np.append(True, tag[1:] != tag[:-1]))
            stop = np.append(edge[1:], total) - 1
            some = before[idx[edge]] > 0
            wl, wh = lf[idx[edge[some]]], lf[idx[stop[some]]]
            keep = ~met[wh + 1]
            lo, hi = np.concatenate([p, wl[keep]]), np.concatenate([p, wh[keep]])
        else:
            lo, hi = p, p
        met[hi + 1] = True
    return ~met[:n]


def repeated_windows(texts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each text, which of its windows of `least` bytes occur at another place in the texts too."""
    sizes = [len(x) for x in texts]
    # Bytes go up by one, so that 0 only ends texts; 255, which no UTF-8 has, would wrap.
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    order = suffix_array(joined, least)
    same = long_prefixes(joined, order, least)
    twice = same | np.append(same[1:], False)
    found = np.zeros(len(joined), bool)
    found[order[twice]] = True
    out, at = [], 0
    for n in sizes:
        out.append(found[at : at + max(0, n - least + 1)])
        at += n + 1
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans (start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their ids, and a key that names the text: equal keys mean equal texts, for rows that repeat an id."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("k"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2"))


def _find_runs(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches) -> Iterator:
        for batch in batches:
            for a, b, data, offsets in buffers(batch.column(2)):
                anchor, at, first, n = runs(data, offsets, least, gram)
                row = np.searchsorted(offsets, first, "right") - 1
                view = memoryview(data)
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(first.tolist(), (first + n + least - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(take), batch.column(1).slice(a, b - a).take(take), pa.array(anchor.view(np.int64)),
                    pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                    pa.array((first - offsets[row]).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array((at - first).astype(np.int32)),
                ], names)

    names = ["k", "k2", "anchor", "d1", "d2", "start", "n", "off"]
    return docs.select("k", "k2", "text").mapInArrow(run, "k long, k2 long, anchor long, d1 long, d2 long, start long, n int, off int")


def _bytes(column) -> list[bytes]:
    """The texts of an Arrow column in UTF-8, as they lie there."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _compare(chosen: DataFrame, docs: DataFrame, least: int, gram: int, crowd: int, stride: int) -> DataFrame:
    """(run, a, b): windows a..b-1 of each chosen run that occur in another chosen run of its anchor, or elsewhere in itself."""
    lists = chosen.groupBy("k", "k2").agg(F.collect_list(F.struct("run", "anchor", "start", "n", "off", "many")).alias("runs"))  # of one text
    texts = docs.join(cut(lists, "lists"), ["k", "k2"]).select("text", "runs")

    def extract(batches) -> Iterator:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for data, found in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for r in found:
                    if r["many"] <= crowd:
                        piece = data[r["start"] : r["start"] + r["n"] + least - 1]
                        out.append((r["anchor"], r["run"], 0, piece))
                        held += len(piece)
                        continue
                    # A crowd: windows are dealt out by where the anchor lies in them, a stride at a time, and by the bytes that all windows of a part share.
                    for part in range(-(-(least - gram + 1) // stride)):
                        a, b = max(0, r["off"] - (part + 1) * stride + 1), min(r["n"], r["off"] - part * stride + 1)
                        if a >= b:
                            continue
                        lo, hi = r["start"] + r["off"] - part * stride, r["start"] + r["off"] - (part + 1) * stride + 1 + least
                        core = xxhash.xxh3_64_intdigest(data[lo:hi], part) - (1 << 63)
                        piece = data[r["start"] + a : r["start"] + b + least - 1]
                        out.append((core, r["run"], a, piece))
                        held += len(piece)
                if held > 4 << 20:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["part", "run", "a", "piece"])

    pieces = texts.select("text", "runs").mapInArrow(extract, "part long, run long, a int, piece binary")

    def found(rows: list[tuple], flags: list[np.ndarray]):
        got = [(r[1], r[2] + s, r[2] + e) for r, f in zip(rows, flags, strict=True) for s, e in zip(*map(np.ndarray.tolist, _spans(f)), strict=True)]
        columns = list(zip(*got, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["run", "a", "b"])

    def windows(rows: list[tuple]) -> list[np.ndarray]:
        return [Rolling(np.frombuffer(r[3], np.uint8)).windows(least) for r in rows]

    def search(batches) -> Iterator:
        release()
        held: list[tuple] = []  # whole parts, as many as fit a suffix array
        group: list[tuple] = []  # the part at hand
        large: list[tuple] = []  # what it has beyond a suffix array: only its windows' hashes stay
        hashes: list[np.ndarray] = []
        size = group_size = 0

        def close():
            nonlocal held, group, large, hashes, size, group_size
            if large:
                large += [r[:3] for r in group]
                hashes += windows(group)
                _, back, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                yield found(large, np.split(counts[back] > 1, np.cumsum([len(x) for x in hashes])[:-1]))
            elif len(group) > 1:  # the windows of one run differ
                if held and size + group_size > BATCH_BYTES:
                    yield found(held, repeated_windows([r[3] for r in held], least))
                    held, size = [], 0
                held += group
                size += group_size
            group, large, hashes, group_size = [], [], [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    yield from close()
                group.append(row)
                group_size += len(row[3])
                if group_size > 2 * BATCH_BYTES and len(group) > 1:
                    large += [r[:3] for r in group[:-1]]
                    hashes += windows(group[:-1])
                    group, group_size = group[-1:], len(row[3])
        if group:
            yield from close()
        if held:
            yield found(held, repeated_windows([r[3] for r in held], least))

    return pieces.repartition("part").sortWithinPartitions("part").mapInArrow(search, "run long, a int, b int")


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Of a buffer: rows and hashes of its fingerprints, by row. Words are runs of letters and digits, A-Z lower-cased; of the hashes of `words` words in
    a row, each passage of `passage` words keeps the least, the last of equals."""
    starts, ends, first = words_in(data, offsets, ALNUM)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(starts) < passage:
        return none
    grams = Rolling(Rolling(data, TABLE_FOLDED).ranges(starts, ends), None).windows(words)
    place = np.arange(len(grams), dtype=np.uint64)
    at = (_LOW - (minima((grams & ~_LOW) | (_LOW - place), passage - words + 1) & _LOW)).astype(np.int64)
    # Passages that cross from one row into the next don't count.
    row = np.searchsorted(first, np.arange(len(at)), "right") - 1
    inside = np.arange(len(at)) + passage <= first[row + 1]
    at, row = at[inside], row[inside]
    fresh = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    return row[fresh], grams[at[fresh]]


def repeated_passages(docs: DataFrame, words: int = WORDS, passage: int = PASSAGE) -> DataFrame:
    """(k, k2, n_repeated) for rows with any: how many fingerprints of `words` words a row holds that occur at another place too, in it or in another row.

    Every passage of `passage` words or more that occurs twice holds such a fingerprint in both places; one in the table means a string of `words` words that
    repeats. docs: k, k2, text; rows of one k and k2 are repeats of one another. Sums come before the shuffles; a passage that many rows
    share is a large key of a join, which AQE splits."""

    def run(batches) -> Iterator:
        release()
        for batch in batches:
            for a, b, data, offsets in buffers(batch.column(2)):
                row, found = fingerprints(data, offsets, words, passage)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(take), batch.column(1).slice(a, b - a).take(take), pa.array(found.view(np.int64))], ["k", "k2", "h"])

    found = cut(docs.select("k", "k2", "text").mapInArrow(run, "k long, k2 long, h long"), "fingerprints")
    twice = cut_small(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated-fingerprints")
    # Rows that repeat a row hold the same ones: each counts its own.
    rows = docs.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    sums = found.join(twice, "h").groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(rows, ["k", "k2"], "left").select("k", "k2", (F.col("n") / F.coalesce("rows", F.lit(1))).cast("long").alias("n_repeated"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, stride: int = STRIDE, keep_text: bool = False, passages: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, with passages n_repeated, and with keep_text the remaining bytes.

    Each byte goes that lies in a string of `least` bytes which also starts at another place, in this text or another; strings may overlap and are judged
    on the input. Null texts count as empty; texts of fewer bytes lose none. All copies go, the first too; so repeated rows (same id and text) lose
    everything that is long enough. n_repeated counts what repeats but may be too short to be removed (see repeated_passages). An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    base = _ids(docs, id_col, text_col)
    found = cut(_find_runs(base, least, gram), "runs")
    kinds = found.groupBy("anchor", "d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k", "k2", "start", "n", "off")).alias("one"))
    kinds = cut(kinds, "run-kinds")
    # Where every kind has copies, all windows are known to repeat.
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("many"), F.min("copies").alias("fewest")).filter("many > 1 AND fewest = 1").select("anchor", "many")
    chosen = cut(kinds.join(shared, "anchor").select(F.monotonically_increasing_id().alias("run"), "anchor", "d1", "d2", "many", "one.*"), "shared-runs")
    partial = _compare(chosen, base, least, gram, crowd, stride).join(chosen.select("run", "anchor", "d1", "d2"), "run").drop("run") if not chosen.isEmpty() else None
    whole = kinds.filter("copies > 1").select("anchor", "d1", "d2", F.lit(0).alias("a"), F.col("one.n").alias("b"))
    spans = whole if partial is None else whole.unionByName(partial)
    marks = cut(spans.groupBy("anchor", "d1", "d2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "marks")  # at most a run's windows
    hits = found.join(marks, ["anchor", "d1", "d2"]).select("k", "k2", "start", "spans")
    hits = hits.groupBy("k", "k2").agg(F.collect_list(F.struct("start", "spans")).alias("hits"))  # of one text
    if passages:
        hits = cut(hits.join(repeated_passages(base), ["k", "k2"], "full"), "hits")
    else:
        hits = cut(hits, "hits").withColumn("n_repeated", F.lit(None).cast("long"))
    # Rows that repeat an id and text have the hits of each; their spans coincide.
    both = base.join(hits, ["k", "k2"], "left").select("id", "text", "hits", "n_repeated")
    kind = base.schema["id"].dataType.simpleString()
    extra = ", kept binary" if keep_text else ""

    def apply(batches) -> Iterator:
        release()
        for batch in batches:
            rows = []
            for data, hits in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if not hits:
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                gone = _covered(np.array([(h["start"] + s["a"], h["start"] + s["b"] + least - 1) for h in hits for s in h["spans"]], np.int64), len(data))
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if keep_text else 4]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:4], batch.column(3).fill_null(0), *made[4:]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"][: 7 if keep_text else 6])

    return both.mapInArrow(apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long{extra}").withColumnRenamed("id", id_col).drop(*([] if passages else ["n_repeated"]))
