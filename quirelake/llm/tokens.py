"""Token-ID output: ORC files of token ids, sorted by document id, and the reader."""

from __future__ import annotations

import json
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Rolling, buffers, cut, new_dir, release, small_batches, whole

#: Words in lower case whose ids a Python worker keeps (some 40 bytes each), and pieces that aren't such words (some 200 bytes each); when full, each starts anew.
WORDS, PIECES = 1_000_000, 100_000
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 4 << 20
END_ID = 2
_workers: dict = {}
#: Latin letters below U+0250, without the one whose lower case is two characters.
LATIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
#: For a second hash of words, independent of the first.
_CHECK = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Pieces(dict):
    """Ids of pieces, found when they are first asked for."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.find(piece)
        return ids


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts - (ends - counts), counts)
    return at


def laid_out(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids one after the other, and where each begins and how many they are."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.frombuffer(b"".join(ids), np.int32), np.cumsum(counts) - counts, counts


class WordEncoder:
    """Token ids of texts, by a tokenizer that treats white space as a boundary.

    Texts are cut at white space only; of the pieces of a batch each distinct one is encoded once. That equals encoding the whole text for
    tokenizers that drop white space and whose patterns do not cross it, such as word_bpe_49k (checked in the tests). Most pieces are a word
    of Latin letters with marks behind: words are kept in lower case, sorted by a hash of 128 bits, from one batch to the next.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.tokenize = self.model.model.tokenize
        self.odd, self.marks = _Pieces(self.slow), _Pieces(self.slow)
        self.forget()
        # Whether letters and marks are apart, case is dropped and the model takes bytes as characters; if not, pieces go to the tokenizer as they are.
        parts = json.loads(self.model.to_str())
        steps = [x["type"] for k in ("normalizer", "pre_tokenizer") for x in (parts[k] or {}).get("normalizers", (parts[k] or {}).get("pretokenizers", ()))]
        self.latin = LATIN if steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] else "a^"
        # Byte-level models write bytes as characters: those that print as themselves, the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def forget(self) -> None:
        """Words: hash, second hash, and where their ids begin and how many they are."""
        self.words = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        self.ids = np.zeros(0, np.int32)

    def slow(self, piece: str) -> bytes:
        return array("I", self.model.encode(piece, add_special_tokens=False).ids).tobytes()

    def fast(self, word: str) -> bytes:
        """A word of Latin letters in lower case, given to the model itself."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [x.id for x in self.tokenize(text)]).tobytes()

    def places(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words begin in self.ids, and how many they are. Words that aren't there yet are encoded."""
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        h, check = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for a, b, data, offsets in buffers(words):
            h[a:b], check[a:b] = (Rolling(data, *table).ranges(offsets[:-1], offsets[1:]) for table in ((), (_CHECK,)))
        if len(self.words[0]):
            at = np.minimum(np.searchsorted(self.words[0], h), len(self.words[0]) - 1)
            there = (self.words[0][at] == h) & (self.words[1][at] == check)
            starts[there], counts[there] = self.words[2][at[there]], self.words[3][at[there]]
        else:
            there = np.zeros(len(words), bool)
        if not there.all():
            new = np.flatnonzero(~there)
            ids, first, n = laid_out([self.fast(w) for w in words.take(pa.array(new)).to_pylist()])
            starts[new], counts[new] = first + len(self.ids), n
            self.ids = np.concatenate([self.ids, ids])
            new = new[np.argsort(h[new])]
            at = np.searchsorted(self.words[0], h[new])
            self.words = tuple(np.insert(x, at, y[new].astype(x.dtype)) for x, y in zip(self.words, (h, check, starts, counts), strict=True))
        return starts, counts

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, one text after the other, and how many each has."""
        if len(self.words[0]) > WORDS:
            self.forget()
        for kept in (self.odd, self.marks):
            if len(kept) > PIECES:
                kept.clear()
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten().dictionary_encode()
        distinct, at = pieces.dictionary, pieces.indices.to_numpy()
        trimmed = pc.utf8_rtrim(distinct, characters=string.punctuation)
        latin = pc.match_substring_regex(trimmed, self.latin)
        words = pc.utf8_lower(trimmed.filter(latin)).dictionary_encode()
        tails = pc.replace_substring_regex(distinct.filter(latin), pattern=r"^[^!-/:-@\[-`{-~]+", replacement="").dictionary_encode()
        starts, counts = self.places(words.dictionary)
        mark_ids, mark_starts, mark_counts = laid_out([self.marks[x] for x in tails.dictionary.to_pylist()])
        odd_ids, odd_starts, odd_counts = laid_out([self.odd[x] for x in distinct.filter(pc.invert(latin)).to_pylist()])
        # Each distinct piece is a word and its marks, or an odd one and nothing.
        all_ids = np.concatenate([self.ids, mark_ids, odd_ids])
        is_latin = latin.to_numpy(zero_copy_only=False)
        first, size = np.zeros((len(distinct), 2), np.int64), np.zeros((len(distinct), 2), np.int64)
        w, t = words.indices.to_numpy(), tails.indices.to_numpy()
        first[is_latin] = np.stack([starts[w], mark_starts[t] + len(self.ids)], 1)
        size[is_latin] = np.stack([counts[w], mark_counts[t]], 1)
        first[~is_latin, 0], size[~is_latin, 0] = odd_starts + len(self.ids) + len(mark_ids), odd_counts
        all_ids = all_ids[spread(first.ravel(), size.ravel())]
        size = size.sum(1)
        first = np.cumsum(size) - size
        each = size[at]
        before = np.append(0, np.cumsum(each))[offsets - offsets[0]]
        return all_ids[spread(first[at], each)], np.diff(before)


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that what it has learnt outlives a task."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def write_token_ids(docs: DataFrame, to: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Writes ORC files of (doc_id, ids) to folder `to`: ids of the whole text, then end_id; files and rows in ascending id order.

    Null texts count as empty (only end_id). Rows with equal ids are all written, in order of a hash of their texts; null ids come first. An empty
    table gives a folder without rows. Other columns are ignored. Row indexes let readers skip by id; Bloom filters on ids answer point
    look-ups by stripe; ids are stored with integer run-length encoding by ORC's writer. Task attempts write to temporary names that the
    job's committer moves, so lost executors leave nothing behind.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]  # the hash parts rows that share an id; long texts would all be sampled
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)

    def ids(batches):
        release()
        coder = encoder(tokenizer)
        for batch in batches:
            for a, b, _, _ in buffers(batch.column(1), BATCH_BYTES):
                part = batch.slice(a, b - a)
                values, lengths = coder.encode(part.column(1))
                ends = np.cumsum(lengths)
                values = np.insert(values, ends, end_id)
                starts = np.append(0, ends + np.arange(1, len(ends) + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = spread.sortWithinPartitions(*keys).mapInArrow(ids, f"doc_id {kind}, ids array<int>")
    with small_batches(docs.sparkSession):
        (
            out.write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", "2000").option("orc.stripe.size", str(32 << 20))
            .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(to)
        )


def read_token_ids(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, ids) of a folder of ORC files; filters on doc_id reach stripes and row groups."""
    return spark.read.orc(at)


def token_index(spark: SparkSession, at: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of all ids as little-endian 32-bit)."""
    def sums(batches):
        from quirelake.llm import tokens

        tokens._workers.clear()  # encoders have done their work
        release()
        for batch in batches:
            ids = batch.column(1)
            offsets = ids.offsets.to_numpy()
            data = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "block", "at", "n_tokens", "ids_crc32"])

    rows = read_token_ids(spark, at).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    one = cut(rows.mapInArrow(sums, f"doc_id {kind}, file string, block long, at long, n_tokens long, ids_crc32 long"), "token-index")
    # Two levels of running sums: over files (few rows), then within each file; rows of a file keep their order.
    files = one.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy(F.col("first").asc_nulls_first(), "file")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("block", "at")) - F.col("n_tokens")
    return one.withColumn("inside", inside).join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, to: str | None = None, **options) -> DataFrame:
    """Writes docs' token ids (see write_token_ids) to a folder, by default a new one in the shared folder, and reports from the files."""
    spark = docs.sparkSession
    to = to or new_dir(spark, "token-ids")
    write_token_ids(docs, to, tokenizer, **options)
    return token_index(spark, to)
