"""What must hold of any intervals, tried on random ones, and the streaming forms."""

import random

from pyspark.sql import functions as F

from spanwise.operators import bounds, joins, setops, windows
from spanwise.streaming.rows import overlaps_static, per_batch

SCHEMA = "idx long, grp long, start long, `end` long, fwd boolean"


def frame(spark, seed, n=120, span=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.randrange(-span, span)
        rows.append((k, rng.randrange(4), s, s + 1 + rng.choice([rng.randrange(5), rng.randrange(60)]), rng.random() < 0.5))
    return spark.createDataFrame(rows, SCHEMA)


def test_invariants(spark):
    a, b = frame(spark, 1), frame(spark, 2, 40)
    merged = setops.merge(a)
    assert joins.overlaps(merged, merged).count() == merged.count()  # each meets itself alone
    left = setops.subtract(a, b).join(a.select("idx", "grp"), "idx").withColumn("idx", F.monotonically_increasing_id())
    assert joins.overlaps(left, b).count() == 0
    lengths = {r["idx"]: r["n"] for r in a.selectExpr("idx", "`end` - start AS n").collect()}
    tiles = windows.tile(a, 7).groupBy("idx").agg(F.round(F.sum("fraction") * 7).cast("long").alias("n"))
    assert {r["idx"]: r["n"] for r in tiles.collect()} == lengths
    pieces = windows.window_grouped(a, 9).groupBy("idx").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max(F.col("end") - F.col("start")).alias("m"))
    found = pieces.collect()
    assert {r["idx"]: r["n"] for r in found} == lengths and max(r["m"] for r in found) <= 9
    for slack in (0, 3):
        pairs = joins.overlaps(a, b, slack=slack).groupBy("idx").count()
        counts = joins.count_overlaps(a, b, slack=slack).filter("n_overlaps > 0")
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, counts.collect()))
    taken = setops.max_disjoint(a).join(a, "idx")
    assert joins.overlaps(taken, taken).count() == taken.count()


def test_binned_equals_plain(spark):
    a, b = frame(spark, 3), frame(spark, 4)
    long = spark.createDataFrame([(900, 1, -10_000, 10_000, True), (901, 2, -3, 5_000_000, True)], SCHEMA)
    a, b = a.unionByName(long), b.unionByName(long)
    for slack in (0, 1, 25):
        for contained in (False, True):
            plans = [sorted(map(tuple, joins.overlaps(a, b, slack=slack, contained=contained, binned=x).collect())) for x in (None, False)]
            assert plans[0] == plans[1]


def test_streams(spark, tmp_path):
    a, b = frame(spark, 5), frame(spark, 6)
    a.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    query = per_batch(overlaps_static(stream, b, 32), lambda x: x, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).select("idx", "idx2")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joins.overlaps(a, b).collect()))
    bounded = bounds.outside_bounds(stream.withColumn("length", F.lit(100)), clip=True)
    query = per_batch(windows.tile(bounded, 10), lambda x: x, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    query.awaitTermination()
    want = windows.tile(bounds.outside_bounds(a.withColumn("length", F.lit(100)), clip=True), 10)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == want.count()
