"""Each stage of the pipeline on odd rows: clashing columns, nulls, empty texts, repeats, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

random.seed(2)
CLASHING = ("doc", "row", "score", "_score", "_row", "_k1", "_k2", "ranges", "taken", "_taken", "_size", "size", "uid", "text_", "id", "h", "t", "rank", "n_shingles", "count", "component_id", "contaminated", "a.b")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "ten words of an item that stand in one document only here and there")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows():
    filler = lambda n: " ".join(random.choices([f"w{i}" for i in range(90)], k=n))
    texts = [filler(random.randrange(3, 60)) for _ in range(60)]
    texts[5] = "see: ten words of an item that stand in one document only here and there, as said"
    texts += [None, "", " \n", texts[8], texts[8] + " more", "x " * 30_000]
    ids = [*range(60), 60, None, 61, 8, 62, None]
    return [(i, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.mark.parametrize("name", [x for x, _ in P.STAGES])
def test_stage(spark, tables, name):
    stage = dict(P.STAGES)[name]
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    odd = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    got, want = stage(spark, odd, tables), stage(spark, plain, tables)
    if name == P.STAGES[-1][0]:
        assert got.count() == want.count() == plain.count()
    else:
        assert got.columns == odd.columns
        key = ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(repr, (tuple(r) for r in got.select(*key).collect()))) == sorted(map(repr, (tuple(r) for r in want.select(*key).collect())))
        assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHING)
    assert stage(spark, odd.limit(0), tables).count() == 0
