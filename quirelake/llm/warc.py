"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page id and cut into shards at splitters drawn by content (so the same pages give the same shards, however they are
partitioned); each shard is written in one pass, rolling files by compressed size. Tasks write under temporary names of their own attempt and report
what they wrote; the driver moves the files of successful attempts to their names and writes the manifest last. Lost executors leave temporary files
that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ahead
from .common import cut, new_dir, whole

ROLL_BYTES = 32 << 20
#: Payload bytes of a shard, about: a SHARDS-th of all, within these bounds.
LEAST_SHARD, MOST_SHARD, SHARDS = 4 << 20, 512 << 20, 1000
#: Records of equal payloads of at least so many bytes become revisits.
REVISIT_BYTES = 0
#: Files that a task moves to their names.
MOVES = 64
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str):
    """(file system, path) of a URI, by pyarrow: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One record, gzipped as a member of its own: headers and digests made anew from what is written."""
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}")
    target = (url or "").replace("\r", "").replace("\n", "")
    body = b"" if refers_to is not None else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {target}"] if target else []
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """(digest, n, first, copies): payloads that occur more than once, and the smallest page id of each. Sums before the shuffle, no payloads in it."""
    groups = pages.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return groups.filter((F.col("copies") > 1) & (F.col("n") >= least))


def write_warc(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Writes a record per row to folder `to` (a URI all executors reach) and returns the manifest's URI.

    Null payloads and urls count as empty. Of records with equal payloads of at least revisit_bytes bytes, that with the smallest page id is a
    response (of rows that repeat this id too, one of them) and the others are revisits. Rows with a null id are written first, as records with an
    empty id; they are responses only where all ids of their payload are null. An empty table gives a manifest without files. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(F.col(html_col)).cast("binary").alias("payload"))
    slim = cut(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"), F.xxhash64("page_id", "url").alias("nth")), "payloads")
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    shard_bytes = shard_bytes or min(MOST_SHARD, max(LEAST_SHARD, total // SHARDS))
    # Cuts: the page id at which each shard_bytes bytes end, in the order of ids. They depend on the pages alone, and there is one for each shard.
    placed = ahead(slim.filter("page_id IS NOT NULL").select("page_id", "digest", "nth", "n"), [F.col("page_id"), F.col("digest"), F.col("nth")], weight="n", name="before")
    firsts = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min("page_id").alias("first")).collect()
    cuts = sorted({r["first"] for r in firsts if r["shard"]})
    # Which rows refer to which: a row for each payload that repeats meets the slim rows, not the payloads; then slim marks meet the payloads, shard by shard.
    repeats = _revisits(slim, revisit_bytes).drop("copies")
    marks = slim.join(repeats, ["digest", "n"]).groupBy("page_id", "digest", "first").agg(F.count(F.lit(1)).alias("copies"))
    marks = marks.filter(~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("copies") > 1)).select("page_id", "digest", F.col("first").alias("refers_to"))
    tagged = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.lit(None).cast(slim.schema["page_id"].dataType).alias("refers_to"), F.lit(1).alias("kind"), F.xxhash64("page_id", "url").alias("nth"))
    marked = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("nth"))
    bounds = spark.sparkContext.broadcast(cuts)  # an id for each shard

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        return pa.array([0 if x is None else bisect_right(bounds.value, x) for x in ids.to_pylist()], pa.int32())

    dealt = tagged.unionByName(marked).withColumn("shard", place("page_id")).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "kind", "nth")
    job = uuid.uuid4().hex
    as_text = dealt.select("shard", F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"), "kind")

    def write(batches) -> Iterator:
        fs, root = filesystem(to)
        temp = f"{root}/_temporary-{job}/{uuid.uuid4().hex}"
        files: list[tuple] = []
        out, size, n, sha = None, 0, 0, None
        shard = mark = known = None
        seen_first = False

        def close():
            nonlocal out
            if out is not None:
                out.close()
                files[-1] = (*files[-1][:3], n, size, sha.hexdigest())
                out = None

        for batch in batches:
            for s, page_id, url, payload, digest, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # marks of a page come before its records
                    mark, known, seen_first = refers_to, (page_id, digest), False
                    continue
                refers = mark if known == (page_id, digest) else None
                if known == (page_id, digest) and page_id == refers and not seen_first:
                    seen_first, refers = True, None  # the first of rows that repeat the smallest id
                if known == (page_id, digest) and page_id is None and mark is None:
                    refers = "" if seen_first else None
                    seen_first = True
                if out is None or size >= roll_bytes or s != shard:
                    close()
                    shard, size, n, sha = s, 0, 0, hashlib.sha256()
                    fs.create_dir(temp, recursive=True)
                    name = f"part-{s:06d}-{sum(x[0] == s for x in files):05d}.warc.gz"
                    files.append((s, f"{temp}/{name}", f"{root}/{name}"))
                    out = fs.open_output_stream(f"{temp}/{name}", compression=None)
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                out.write(data)
                sha.update(data)
                size, n = size + len(data), n + 1
        close()
        columns = list(zip(*files, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "temp", "name", "records", "bytes", "sha256"])

    done = as_text.mapInArrow(write, "shard int, temp string, name string, records long, bytes long, sha256 string").collect()  # a row for each file
    fs, root = filesystem(to)
    fs.create_dir(root, recursive=True)
    manifest = []
    for r in sorted(done, key=lambda r: r["name"]):
        manifest.append({"file": r["name"].removeprefix(f"{root}/"), "records": r["records"], "bytes": r["bytes"], "sha256": r["sha256"]})

    def move(batches) -> Iterator:
        own, _ = filesystem(to)
        for batch in batches:
            for temp, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own.get_file_info(temp).type.name == "File":
                    own.move(temp, name)
                elif own.get_file_info(name).type.name != "File":  # else an attempt before this one has moved it
                    raise FileNotFoundError(temp)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["moved"])

    if done:
        spark.createDataFrame([(r["temp"], r["name"]) for r in done], "temp string, name string").repartition(-(-len(done) // MOVES)).mapInArrow(move, "moved long").collect()
    if fs.get_file_info(f"{root}/_temporary-{job}").type.name == "Directory":
        fs.delete_dir(f"{root}/_temporary-{job}")
    with fs.open_output_stream(f"{root}/_manifest.tmp") as f:
        f.write(json.dumps({"files": manifest}, indent=1).encode())
    fs.move(f"{root}/_manifest.tmp", f"{root}/manifest.json")
    return f"{to}/manifest.json"


def records(stream, size: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(size):
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = b""
            if unpack.eof:
                chunk, unpack = unpack.unused_data, zlib.decompressobj(31)
                head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
                parts = []
                headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                yield headers, rest[: int(headers["Content-Length"])]
    if parts and any(parts):
        raise ValueError("a record is cut short")


def read_warc(spark: SparkSession, at: str, payloads: bool = False) -> DataFrame:
    """Of the files that the manifest in folder `at` names, a row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and payload
    if asked for (of revisits null). Digests of what is read are checked against the headers."""
    fs, root = filesystem(at)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]

    def read(batches) -> Iterator:
        own, base = filesystem(at)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * payloads)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with own.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: digest of {h['WARC-Record-ID']}")
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if kind == "response" and (digest != base32_sha1(payload) or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError(f"{name}: payload of {h['WARC-Record-ID']}")
                        rows.append((h["X-Page-ID"] or None, int(h["X-Payload-Length"]), digest, kind, h.get("X-Refers-To-Page") or None, h.get("WARC-Target-URI"), *[payload if kind == "response" else None] * payloads))
                        held += len(payload) * payloads + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string" + ", payload binary" * payloads
    listed = spark.createDataFrame([(x["file"],) for x in files], "file string").repartition(max(1, len(files)))
    return listed.mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, to: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Writes pages' archives to a folder, by default a new one in the shared folder, and reports what the reader finds in them."""
    spark = pages.sparkSession
    to = to or new_dir(spark, "warc")
    write_warc(pages, to, id_col, **options)
    kind = pages.schema[id_col].dataType
    return read_warc(spark, to).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
