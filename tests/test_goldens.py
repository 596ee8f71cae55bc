"""Literal vectors: what is published, and hand traces of what is not."""

import pytest

from spanwise.functions import columns
from spanwise.operators import bounds, joins, setops, windows
from spanwise.plans import running
from spanwise.sources.intervals import as_intervals, read_intervals, validate_intervals, write_intervals

SCHEMA = "idx long, grp long, start long, `end` long"


def rows(spark, spans, grp=1):
    groups = grp if isinstance(grp, list) else [grp] * len(spans)
    return spark.createDataFrame([(i, g, s, e) for i, ((s, e), g) in enumerate(zip(spans, groups))], SCHEMA)


def stranded(spark, spans, fwd, grp=1):
    return rows(spark, spans, grp).selectExpr("*", f"{str(fwd).lower()} AS fwd")


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


O1 = ([(1, 5), (10, 20), (30, 40)], [(3, 4), (11, 12), (18, 19), (35, 36)])
Q2 = [(s, s + 1000) for s in (97, 981, 1000, 1227, 1409, 3889, 4398, 4815, 5004, 5047)]
T2 = [(s, s + 1000) for s in (1476, 2110, 2823, 3547, 3578, 4295, 5184, 5545, 7117, 7190)]


@pytest.mark.parametrize("binned", [None, False])
@pytest.mark.parametrize(
    "q, t, options, expected",
    [
        (*O1, {}, [(0, 0), (1, 1), (1, 2), (2, 3)]),
        (Q2, T2, {}, list(zip((1, 2, 3, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 8, 8, 8, 9, 9, 9), (0, 0, 0, 1, 0, 1, 3, 4, 5, 3, 4, 5, 6, 5, 6, 7, 5, 6, 7, 5, 6, 7)))),
        (Q2, T2, {"overlap_type": "first"}, list(zip(range(1, 10), (0, 0, 0, 0, 3, 3, 5, 5, 5)))),
        (Q2, T2, {"overlap_type": "last"}, list(zip(range(1, 10), (0, 0, 1, 1, 5, 6, 7, 7, 7)))),
        ([(10, 12), (10, 30)], [(9, 40), (11, 29)], {"contained": True}, [(0, 0), (1, 0)]),
        ([(1, 3), (6, 9)], [(1, 9)], {"contained": True}, [(0, 0), (1, 0)]),
        ([(1, 3), (4, 9)], [(1, 10), (2, 3), (2, 9)], {"overlap_type": "first", "contained": True, "slack": -2}, [(0, 0), (1, 0)]),
        ([(10, 12), (0, 5), (20, 30)], [(11, 13), (3, 4)], {}, [(0, 0), (1, 1)]),
        ([(10, 20)], [(20, 25)], {}, []),
        ([(10, 20)], [(20, 25)], {"slack": 1}, [(0, 0)]),
        ([(-100, -3), (-5, 1 << 40)], [(-4, -3), (7, 8)], {}, [(0, 0), (1, 0), (1, 1)]),
    ],
)
def test_overlaps(spark, q, t, options, expected, binned):
    assert got(joins.overlaps(rows(spark, q), rows(spark, t), binned=binned, **options), "idx", "idx2") == sorted(expected)


def test_merge(spark):
    m1 = rows(spark, [(10, 14), (1, 5), (4, 7), (0, 3)], [1, 1, 1, 2])
    assert got(setops.merge(m1), "idx", "start", "end", "count") == [(0, 10, 14, 1), (1, 1, 7, 2), (3, 0, 3, 1)]
    m2 = rows(spark, [(1, 6), (6, 8)])
    assert got(setops.merge(m2), "idx", "count") == [(0, 1), (1, 1)]
    assert got(setops.merge(m2, slack=1), "idx", "start", "end", "count") == [(0, 1, 8, 2)]
    assert got(setops.cluster(m1), "idx", "cluster_id") == [(0, 1), (1, 0), (2, 0), (3, 3)]


def test_nearest(spark):
    near = joins.nearest(rows(spark, [(5, 10)]), rows(spark, [(1, 5)]), direction="backward")
    assert got(near, "idx", "idx2", "distance") == [(0, 0, 1)]
    near = joins.nearest(rows(spark, [(1, 5)]), rows(spark, [(5, 10)]), direction="forward")
    assert got(near, "idx", "idx2", "distance") == [(0, 0, 1)]
    ties = rows(spark, [(0, 5), (2, 5), (20, 21), (30, 31)])
    near = joins.nearest(rows(spark, [(10, 12)]), ties, k=2)
    assert got(near, "idx2", "distance") == [(0, 6), (1, 6), (2, 9)]
    assert joins.nearest(rows(spark, [(10, 12)]), ties, k=0).count() == 0


def test_hand_traces(spark):
    assert got(setops.max_disjoint(rows(spark, [(0, 5), (5, 9), (6, 8)])), "idx") == [(0,), (2,)]
    assert got(joins.non_overlaps(rows(spark, [(0, 100)]), rows(spark, [(10, 20)])), "idx") == []
    assert got(joins.non_overlaps(rows(spark, [(0, 100)]), rows(spark, []), slack=3), "idx") == [(0,)]
    spans = [(0, 7), (10, 15)]
    assert got(windows.window_grouped(stranded(spark, spans, True), 5), "start", "end") == [(0, 5), (5, 7), (10, 13), (13, 15)]
    assert got(windows.window_grouped(stranded(spark, spans, False), 5), "start", "end") == [(0, 2), (2, 7), (10, 15)]
    tiles = windows.tile(rows(spark, [(99, 100), (100, 250)]), 100)
    assert got(tiles, "start", "end", "fraction") == [(0, 100, 0.01), (100, 200, 1.0), (200, 300, 0.5)]
    tiles = windows.tile_grouped(stranded(spark, [(-25, -5)], False), 10)
    assert got(tiles, "tile_no", "start") == [(0, -10), (1, -20), (2, -30)]
    assert got(setops.subtract(rows(spark, [(0, 10)]), rows(spark, [(2, 4), (4, 6)])), "start", "end") == [(0, 2), (6, 10)]
    assert got(setops.subtract(rows(spark, [(0, 10)]), rows(spark, [])), "start", "end") == [(0, 10)]
    lengths = spark.createDataFrame([(1, 20)], "grp long, length long")
    assert got(setops.gaps(rows(spark, [(5, 8)]), lengths=lengths, include_first=True), "start", "end") == [(0, 5), (8, 20)]
    found = setops.boundary(rows(spark, [(3, 9), (1, 4), (5, 9)]))
    assert got(found, "idx", "start", "end", "count") == [(2, 1, 9, 3)]


def test_large_groups_are_cut(spark):
    spans = [((k * 37) % 500, (k * 37) % 500 + k % 9 + 1) for k in range(200)]
    df = rows(spark, spans, [k % 2 for k in range(200)])
    for slack in (0, 2):
        assert got(setops.merge(df, slack=slack, width=13), "idx", "end", "count") == got(setops.merge(df, slack=slack, width=None), "idx", "end", "count")
    assert got(setops.max_disjoint(df, width=17), "idx") == got(setops.max_disjoint(df, width=None), "idx")
    assert got(windows.group_cumsum(df, width=11), "idx", "start") == got(windows.group_cumsum(df, width=None), "idx", "start")
    counts = [got(joins.count_overlaps(df, df, width=w), "idx", "n_overlaps") for w in (19, None)]
    assert counts[0] == counts[1]
    pairs = got(joins.overlaps(df, df).groupBy("idx").count(), "idx", "count")
    assert counts[0] == pairs


def test_extension_and_bounds(spark):
    df = stranded(spark, [(10, 20), (10, 30), (15, 30)], False)
    assert got(bounds.extend_grp(df, 3, 5), "idx", "start", "end") == [(0, 7, 20), (1, 10, 35), (2, 15, 30)]
    df = rows(spark, [(-5, 3), (2, 8), (8, 12), (12, 15)]).selectExpr("*", "10L AS length")
    assert got(bounds.outside_bounds(df), "idx") == [(1,)]
    assert got(bounds.outside_bounds(df, only_right=True), "idx") == [(0,), (1,)]
    assert got(bounds.outside_bounds(df, clip=True), "idx", "start", "end") == [(0, 0, 3), (1, 2, 8), (2, 8, 10)]
    assert got(bounds.outside_bounds(df, clip=True, only_right=True), "idx", "start") == [(0, -5), (1, 2), (2, 8)]
    assert bounds.check_extension(4) == (4, 4) and bounds.check_extension(ext_5=2) == (0, 2)
    for bad in ({}, {"ext": 1, "ext_3": 1}):
        with pytest.raises(ValueError):
            bounds.check_extension(**bad)


def test_arguments(spark):
    df = rows(spark, [(0, 1)])
    for call in (
        lambda: joins.overlaps(df, df, overlap_type="some"),
        lambda: joins.nearest(df, df, direction="up"),
        lambda: windows.tile(df, 0),
        lambda: windows.window_grouped(df, -1),
        lambda: validate_intervals(df, "ignore"),
        lambda: bounds.positions(df, "middle"),
    ):
        with pytest.raises(ValueError):
            call()
    assert got(joins.overlaps(df, df, overlap_type="FIRST"), "idx", "idx2") == [(0, 0)]


def test_validation_and_nulls(spark):
    df = spark.createDataFrame([(0, 1, 5, 5), (1, 1, 3, 9), (2, None, 1, 2)], SCHEMA)
    assert got(validate_intervals(df, "drop"), "idx") == [(1,)]
    with pytest.raises(Exception, match="without length"):
        validate_intervals(df).collect()
    some = df.filter("idx > 0")
    assert got(joins.overlaps(some, some), "idx", "idx2") == [(1, 1)]
    assert got(joins.count_overlaps(some, some), "idx", "n_overlaps") == [(1, 1), (2, 0)]


def test_source_and_joined_rows(spark, tmp_path):
    raw = spark.createDataFrame([(7, "a", 1, 4, "+"), (8, "a", 3, 6, "-")], "id int, chrom string, s int, e int, strand string")
    df = as_intervals(raw, "id", "s", "e", {"chrom": "chrom"}, raw["strand"] == "+", keep=["strand"])
    write_intervals(df, str(tmp_path / "x"), partition_by=["chrom"])
    back = read_intervals(spark, str(tmp_path / "x"))
    assert got(back, "idx", "chrom", "start", "end", "fwd") == [(7, "a", 1, 4, True), (8, "a", 3, 6, False)]
    assert got(joins.overlap_join(back, back, ["chrom"], how="left_anti"), "idx") == []
    assert got(joins.overlap_join(back, back, ["chrom"]), "idx", "idx2", "start2") == [(7, 7, 1), (7, 8, 3), (8, 7, 1), (8, 8, 3)]


def test_expressions(spark):
    df = spark.createDataFrame([(-7, -3, 1, 2)], "s long, e long, s2 long, e2 long")
    row = df.select(
        columns.floor_div("s", 2).alias("f"),
        columns.tile_start_expr("s", 5).alias("t"),
        columns.distance_expr("s", "e", "s2", "e2").alias("d"),
        columns.contains_expr("s", "e", "s", "e").alias("c"),
    ).first()
    assert tuple(row) == (-4, -10, 5, True)


def test_missing_length_fails(spark):
    df = rows(spark, [(1, 2), (3, 4)]).selectExpr("*", "CASE WHEN idx = 0 THEN 10L END AS length")
    for clip in (False, True):
        with pytest.raises(Exception, match="no length"):
            bounds.outside_bounds(df, clip=clip).collect()


def test_hot_groups_are_cut_wherever_their_rows_are(spark, monkeypatch):
    """One group crowded into few positions, and one at a single position, come out as by a plain window."""
    monkeypatch.setattr(running, "GROUP_ROWS", 60)
    monkeypatch.setattr(running, "SEGMENT_ROWS", 20)
    crowded = [(1000 + k % 3, 1001 + k % 3 + k % 5) for k in range(150)]
    df = rows(spark, [*crowded, *[(7, 9)] * 120, (0, 5000), (4000, 4001), (-9, -2)], [1] * 150 + [2] * 120 + [1, 1, 3])
    cut = running.segment_width(df, ["grp"])
    assert cut.n > 5
    sizes = df.select("grp", cut.segment().alias("s")).groupBy("grp", "s").count().agg({"count": "max"}).first()[0]
    assert sizes < 80  # of 150 and 120
    assert running.segment_width(df.limit(50), ["grp"]) is None
    for run, names in (
        (lambda w: setops.merge(df, slack=1, width=w), ("idx", "end", "count")),
        (lambda w: setops.cluster(df, width=w), ("idx", "cluster_id")),
        (lambda w: setops.gaps(df, include_first=True, width=w), ("grp", "start", "end", "idx")),
        (lambda w: setops.split(df, between=True, width=w), ("grp", "start", "end", "idx")),
        (lambda w: setops.max_disjoint(df, width=w), ("idx",)),
        (lambda w: windows.group_cumsum(df, width=w), ("idx", "start")),
        (lambda w: bounds.rank_in_group(df, bounds.sort_keys(df), width=w), ("idx", "rank")),
        (lambda w: joins.count_overlaps(df, df, slack=1, width=w), ("idx", "n_overlaps")),
        (lambda w: joins.nearest(df, df, k=2, include_overlaps=False, width=w), ("idx", "idx2", "distance")),
    ):
        assert got(run(0), *names) == got(run(None), *names)


def test_one_long_stretch(spark):
    """Rows that all reach into the next: the greedy choice over more rows than one array gathers."""
    spans = [(10 * k, 10 * k + 15) for k in range(3000)]
    assert got(setops.max_disjoint(rows(spark, spans)), "idx") == [(k,) for k in range(0, 3000, 2)]


@pytest.mark.parametrize("contained", [False, True])
@pytest.mark.parametrize("slack", [-1, -3, -8])
def test_negative_slack_by_bins(spark, slack, contained):
    q = [(k * 7 % 60, k * 7 % 60 + 1 + k % 13) for k in range(60)]
    t = [(k * 11 % 60, k * 11 % 60 + 1 + k % 17) for k in range(60)]
    plain, binned = (joins.overlaps(rows(spark, q), rows(spark, t), slack=slack, contained=contained, binned=b) for b in (False, None))
    assert got(binned, "idx", "idx2") == got(plain, "idx", "idx2")


def test_events_at_the_edges_of_numbers(spark):
    a, b = rows(spark, [(3, 9), (5, (1 << 63) - 2)]), rows(spark, [(1, 2)])
    found = got(bounds.events_of_two(a, b, slack=4, clamp=True), "pos", "is_start", "set_no", "idx")
    assert found == [(0, True, 1, 0), (1, True, 1, 1), (1, True, 2, 0), (2, False, 2, 0), (13, False, 1, 0), ((1 << 63) - 1, False, 1, 1)]
    with pytest.raises(ValueError):
        bounds.edge_events(a, "middle")
