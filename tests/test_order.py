"""Places and running totals by ranges, against sorting."""

import random

from pyspark.sql import functions as F

from quirelake.functions.order import ahead

random.seed(3)


def test_places_over_the_whole_table_and_within_groups(spark):
    rows = [(i, random.choice(["a", "b", None]) if i % 3 else "hot", random.randint(0, 50), random.randint(0, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int, w int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.ahead for r in ahead(df, [F.desc("v"), F.col("id")]).collect()}
        order = sorted(rows, key=lambda r: (-r[2], r[0]))
        assert got == {r[0]: i for i, r in enumerate(order)}
        got = {r.id: r.before for r in ahead(df, [F.col("v"), F.col("id")], ("g",), "w", "before").collect()}
        sums, want = {}, {}
        for i, g, _, w in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = sums.get(g, 0)
            sums[g] = want[i] + w
        assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ahead(df.limit(0), [F.col("v")]).count() == 0
