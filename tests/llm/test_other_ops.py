"""Writers, the classifier, the mix and the pipeline."""

import base64
import gzip
import hashlib
import json
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.llm import mixing, queries, tokens, toxicity, warc

random.seed(8)
WORDS = [f"w{i}" for i in range(300)]


def filler(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


# ------------------------------------------------------------------ WARC


def pages(spark):
    html = ["<p>a</p>", "<p>a</p>", "é" * 10, None, "", "x" * 5000, "<p>a</p>", "y", "y"]
    rows = [(i * 3, f"http://h/{i}" if i % 2 else None, h, i) for i, h in enumerate(html)] + [(18, "http://again/", "<p>a</p>", 9), (None, "u", "y", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


@pytest.mark.parametrize("options", [{}, {"roll_bytes": 600, "shard_bytes": 1000}])
def test_warc(spark, tmp_path, options):
    df = pages(spark).repartition(3)
    at = f"file://{tmp_path}/w"
    got = warc.warc_round_trip(df, at, **options).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[(r.html or "").encode()].append(r.page_id)
    assert len(got) == df.count()
    seen = defaultdict(list)
    for r in got:
        data = next(k for k in groups if base64.b32encode(hashlib.sha1(k).digest()).decode() == r.payload_digest)
        seen[data].append((r.page_id, r.record_type, r.refers_to))
        assert r.payload_bytes == len(data)
    for data, ids in groups.items():
        first = min(x for x in ids if x is not None)
        assert sum(k == "response" for _, k, _ in seen[data]) == 1
        for page, kind, refers in seen[data]:
            assert (page == first and refers is None) if kind == "response" else refers == first
    assert {x for x in os.listdir(f"{tmp_path}/w") if not x.endswith(".warc.gz")} == {"manifest.json"}


def test_warc_is_deterministic_and_plain_gzip(spark, tmp_path):
    df = pages(spark).filter("page_id IS NOT NULL")
    sums = []
    for n in (1, 5):
        warc.write_warc(df.repartition(n), f"file://{tmp_path}/{n}", shard_bytes=1000)
        files = json.load(open(f"{tmp_path}/{n}/manifest.json"))["files"]
        sums.append([(x["file"], x["sha256"]) for x in files])
        for x in files:
            data = open(f"{tmp_path}/{n}/{x['file']}", "rb").read()
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and hashlib.sha256(data).hexdigest() == x["sha256"]
    assert sums[0] == sums[1] and len(sums[0]) > 1


def test_warc_small_payloads_and_no_pages(spark, tmp_path):
    df = pages(spark)
    got = warc.warc_round_trip(df, f"file://{tmp_path}/r", revisit_bytes=5).filter("payload_bytes < 5").collect()
    assert got and all(r.record_type == "response" for r in got)
    assert warc.warc_round_trip(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_reader_notices_damage(spark, tmp_path):
    warc.write_warc(pages(spark), f"file://{tmp_path}/d")
    name = next(x for x in os.listdir(f"{tmp_path}/d") if x.endswith(".gz"))
    with open(f"{tmp_path}/d/{name}", "rb") as f:
        data = f.read()
    with open(f"{tmp_path}/d/{name}", "wb") as f:
        f.write(data[: len(data) - 20])
    with pytest.raises(Exception, match="cut short|PythonException|Error"):
        warc.read_warc(spark, f"file://{tmp_path}/d").collect()


# ------------------------------------------------------------------ tokens


ODD = ["İstanbul. Σίσυφος ΟΔΟΣ, don't I'LL a.b,c ,x .. ... ª º ŉ Ǆ ǅ straße ẞ <|endoftext|> x<|endoftext|>.  a b, \x1c\x1d é é ́x Å K  z 3x 12,5. ½ ²\ttab\r\nfoo\x85bar 中文, 日本 한국어. naïve, Œuvre. à. ſ Ǝ ə", "", None, " ", "word&&& %%%x| |", "a" * 3000]


def test_tokens_equal_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*ODD, *(filler(random.randint(0, 50)) for _ in range(30)), "long " * 20_000]
    df = spark.createDataFrame([(1000 - i, t, 0, 0) for i, t in enumerate(texts)] + [(5, "twice", 0, 0), (5, "twice", 0, 0)], "doc_id long, text string, ids int, start int").repartition(4)
    got = sorted(tokens.token_output(df, queries.tokenizer_path(), f"file://{tmp_path}/t").collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for (i, t), r in zip(sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: x[0]), got, strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = tokens.read_token_ids(spark, f"file://{tmp_path}/t").filter("doc_id = 5").collect()
    assert len(back) == 2 and all(r["ids"][-1] == 2 for r in back)
    assert tokens.token_output(df.limit(0), queries.tokenizer_path(), f"file://{tmp_path}/e").count() == 0


def test_caches_that_fill_up_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*(x or "" for x in ODD), *(filler(40) for _ in range(20))]
    want = [model.encode(x, add_special_tokens=False).ids for x in texts]
    for words, pieces, step in ((10**6, 10**5, 100), (10**6, 10**5, 1), (3, 3, 1), (3, 3, 5)):
        monkeypatch.setattr(tokens, "PIECES", pieces)
        monkeypatch.setattr(tokens, "WORDS", words)
        coder = tokens.WordEncoder(queries.tokenizer_path())
        got = []
        for at in range(0, len(texts), step):
            values, lengths = coder.encode(pa.array(texts).slice(at, step))
            got += [x.tolist() for x in np.split(values, np.cumsum(lengths)[:-1])]
        assert got == want


# ------------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    got = toxicity.toxicity(read("documents"), read("labels")).join(read("labels"), "doc_id").filter("held_out").collect()
    hit = [r for r in got if r.predicted]
    toxic = [r for r in got if r.toxic == 1]
    assert len(got) > 500 and sum(r.toxic for r in hit) >= 0.95 * len(hit) and sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    ranks = np.argsort(np.argsort([r.score for r in got]))
    y = np.array([r.toxic for r in got]) == 1
    assert (ranks[y].mean() - (y.sum() - 1) / 2) / (~y).sum() > 0.97


def test_toxicity_never_learns_held_out_labels(spark):
    docs = spark.createDataFrame([(i, filler(20) + (" vile" if i % 4 == 0 else ""), "vile", i) for i in range(300)] + [(None, None, "", 0), (7, "", "", 0)], "doc_id long, text string, source string, score int")
    labels = docs.select("doc_id", (F.col("text").contains("vile")).cast("int").alias("toxic"), F.lit(1).alias("lang")).distinct()
    got = {(r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, turned).collect()} == got
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i, r in out.items() if r.held_out) and not out[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(r.score == 0.5 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------ mixing


def mix_docs(spark):
    rows = [(i, filler(random.randint(0, 40)), s, 1) for i, s in enumerate(["b"] * 60 + ["a"] * 10 + [None] * 15 + ["é"] * 8 + ["tiny"])]
    return spark.createDataFrame([*rows, (500, None, "a", 1), (501, "", "void", 1), (502, "one", None, 1), (502, "one", None, 1)], "doc_id long, text string, source string, target int")


def poured(sizes):
    """Targets by pouring: weights 5, 2, 1 by name, null last; what is over the bound is poured again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= full


def test_mix(spark):
    docs = mix_docs(spark)
    got = mixing.mix_sources(docs, block=16).collect()
    sizes = defaultdict(int)
    source = {}
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
        source[r.doc_id] = r.source
    want = poured(sizes)
    taken = defaultdict(int)
    assert len(got) == docs.count()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5), block=16).collect()), key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_slots_are_a_multinomial_draw_with_each_place_once(spark):
    _, pieces, slots = mixing.mix_plan(mix_docs(spark), block=16, shard=8)
    rows = slots.collect()
    assert sorted(r.place for r in rows) == list(range(len(rows)))
    for key in {(r["rank"], r["pass"]) for r in rows}:
        blocks = [r.block for r in rows if (r["rank"], r["pass"]) == key]
        assert len(blocks) == len(set(blocks))
    shards = {r.shard: [] for r in rows}
    for r in rows:
        shards[r.shard].append(r["rank"])
    assert all(len(v) == 8 for k, v in shards.items() if k < len(shards) - 1) and len({tuple(sorted(v)) for v in shards.values()}) > 3
    assert mixing.shard_counts(slots).agg(F.sum("slots")).head()[0] == len(rows)
    # The taken words, block by block, are what pieces and slots say.
    held = defaultdict(list)
    for p in pieces.collect():
        held[p["rank"], p.block].append(p)
    total = sum(max(0, min(p.to, p["from"] + r.words - p["at"]) - p["from"]) for r in rows for p in held[r["rank"], r.block])
    assert total == mixing.taken_ranges(pieces, slots).agg(F.sum(F.col("to") - F.col("from"))).head()[0]


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mix_texts(spark):
    docs = mix_docs(spark).drop("target")
    taken = {r.doc_id: 0 for r in docs.collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = mixing.mix_texts(docs, block=16)
    assert rows.columns == docs.columns
    for r in rows.collect():
        words = r.text.split()
        assert words and (r.text == text[r.doc_id] or set(words) <= set(text[r.doc_id].split()))
        taken[r.doc_id] += len(words)
    want = defaultdict(int)
    for r in mixing.mix_sources(docs, block=16).collect():
        want[r.doc_id] += r.taken
    assert taken == want


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = docs
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, P.cut(stage(spark, docs, d), "test-stage")
        assert docs.columns == first.columns and docs.count() > 0, name
        ids = {r.doc_id for r in before.collect()}
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= ids
        if name.startswith("toxicity"):
            assert kept == {r.doc_id for r in toxicity.toxicity(before, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 0").collect()}
        if name.startswith("n-gram"):
            from quirelake.llm import jaccard

            classes = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(before).collect()}
            assert kept == set(classes.values())
        if name.startswith("benchmark"):
            from quirelake.llm import decontam

            marks = decontam.decontaminate(before, spark.read.parquet(f"{d}/benchmark.parquet")).collect()
            assert kept == {r.doc_id for r in marks if not r.contaminated}
    out = P.run(spark, d).collect()
    assert len(out) == docs.count() and {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
    assert min(r.start for r in out) == 0 and len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_pipeline_filters_rows_by_id_and_text(spark, tmp_path):
    import corpus_pipeline as P

    w = [f"v{i}" for i in range(60)]
    leak, base, near = "one two three four five six seven eight nine ten", " ".join(w), " ".join([*w[:59], "end"])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, base), (None, near), (None, "no copy of any"), (7, near), (7, "clean words"), (8, f"so {leak} it goes"), (8, "clean too"), (None, leak), (9, "twice"), (9, "twice"), (None, ""), (None, "")], "doc_id long, text string")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = P.keep_one_of_near_copies(spark, docs, str(tmp_path))
    assert rows(kept) == sorted([(1, base), (None, "no copy of any"), (7, "clean words"), (8, f"so {leak} it goes"), (8, "clean too"), (None, leak), (9, "twice"), (None, ""), (None, "")], key=str)
    clean = P.drop_contaminated(spark, kept, str(tmp_path))
    assert rows(clean) == sorted([(1, base), (None, "no copy of any"), (7, "clean words"), (8, "clean too"), (9, "twice"), (None, ""), (None, "")], key=str)


def test_warc_files_depend_on_the_pages_alone(spark, tmp_path):
    """Neither the partitions of the input, nor those of shuffles, nor how ids are spread change a shard; shards are cut by bytes without a cap."""
    df = spark.createDataFrame([(i * i % 5003, f"u{i}", "x" * (i % 97)) for i in range(3000)], "page_id long, url string, html string")
    sums = []
    for n, parts in ((1, "3"), (6, "11")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        warc.write_warc(df.repartition(n), f"file://{tmp_path}/{n}", shard_bytes=150)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sums.append([(x["file"], x["sha256"], x["records"]) for x in json.load(open(f"{tmp_path}/{n}/manifest.json"))["files"]])
    assert sums[0] == sums[1] and len(sums[0]) > 600 and sum(x[2] for x in sums[0]) == 3000
    assert {x for x in os.listdir(f"{tmp_path}/1") if not x.startswith("part-")} == {"manifest.json"}
