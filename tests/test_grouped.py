"""Whole groups dealt to tasks once: the same rows as the plans for large groups, and no row that travels twice."""

import random

import pytest
from pyspark.sql import functions as F

from spanwise.operators import joins, setops
from spanwise.plans import catalog, grouped

SCHEMA = "idx long, grp long, start long, `end` long, tag string"
DATA = "/root/testdata/sf0.001"


def frame(spark, seed, n=150, first=0):
    """Crowded and scattered rows, long and short, some with nulls."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.choice([rng.randrange(-40, 40), rng.randrange(-900, 900)])
        rows.append((first + k, rng.randrange(5), s, s + 1 + rng.choice([0, rng.randrange(9), rng.randrange(200)]), f"t{k}"))
    rows += [(first + n, None, 1, 5, "a"), (first + n + 1, 1, None, 5, "b"), (first + n + 2, 9, -3000, 3000, "c")]
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def large(monkeypatch):
    """From now on every group counts as too large."""
    monkeypatch.setattr(grouped, "FEW_ROWS", 0)
    monkeypatch.setattr(grouped, "MOST_ROWS", 0)


def dealt(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("way", joins.DIRECTIONS)
@pytest.mark.parametrize("include", [True, False])
def test_nearest(spark, monkeypatch, way, include):
    a, b = frame(spark, 1), frame(spark, 2, 60)
    cases = [(1, 0), (3, 2)]
    some = [joins.nearest(a, b, k=k, slack=s, include_overlaps=include, direction=way) for k, s in cases]
    assert [dealt(df) for df in some] == [1, 1]
    rows = [got(df) for df in some]
    large(monkeypatch)
    assert rows == [got(joins.nearest(a, b, k=k, slack=s, include_overlaps=include, direction=way)) for k, s in cases]
    assert all(rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_overlap_join(spark, monkeypatch, how):
    a, b = frame(spark, 3).drop("tag").withColumn("n", F.col("idx") % 3), frame(spark, 4, 40)
    some = [joins.overlap_join(a, b, slack=s, how=how, suffix=x) for s, x in ((0, "2"), (4, "_b"))]
    assert [dealt(df) for df in some] == [1, 1]
    rows = [(df.columns, got(df)) for df in some]
    large(monkeypatch)
    assert rows == [(df.columns, got(df)) for df in (joins.overlap_join(a, b, slack=s, how=how, suffix=x) for s, x in ((0, "2"), (4, "_b")))]
    assert all(r for _, r in rows)


def test_counts(spark, monkeypatch):
    a, b = frame(spark, 5), frame(spark, 6, 40)
    some = [joins.count_overlaps(a, b, slack=s) for s in (0, 7)]
    assert [dealt(df) for df in some] == [1, 1]
    rows = [got(df) for df in some]
    large(monkeypatch)
    assert rows == [got(joins.count_overlaps(a, b, slack=s)) for s in (0, 7)]


def test_subtract(spark, monkeypatch):
    a, b = frame(spark, 7), frame(spark, 8, 30)
    some = setops.subtract(a, b)
    assert dealt(some) == 2  # what is subtracted is merged first
    rows = got(some)
    large(monkeypatch)
    assert rows == got(setops.subtract(a, b)) and rows


def test_map_to_global(spark, monkeypatch):
    exons = frame(spark, 9, 80).selectExpr("grp AS tx", "start AS local_start", "`end` AS local_end", "tag AS chr", "start * 10 AS genome_start", "`end` * 10 AS genome_end", "idx % 2 = 0 AS fwd")
    queries = frame(spark, 10, 60).selectExpr("idx", "grp AS tx", "start", "`end`", "idx % 3 = 0 AS fwd")
    some = joins.map_to_global(exons, queries)
    assert dealt(some) == 1
    rows = got(some)
    large(monkeypatch)
    assert rows == got(joins.map_to_global(exons, queries)) and rows


def test_exons_are_not_joined(spark):
    plan = catalog.QUERIES["map_to_global"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" not in plan and "HashJoin" not in plan


def test_large_groups_are_not_dealt_whole(spark):
    rows = spark.range(grouped.FEW_ROWS + 1).select(F.lit(1).alias("grp"))
    assert grouped.task_count([rows], ["grp"]) is None
    assert grouped.task_count([rows, rows.limit(0)], ["grp"]) is None
    assert grouped.task_count([spark.range(grouped.TASK_ROWS * 2 + 1).selectExpr("id % 1000 AS grp")], ["grp"]) == 3
    assert grouped.task_count([rows.limit(0)], ["grp"]) == 1
