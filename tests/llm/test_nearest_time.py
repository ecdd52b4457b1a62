import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from telar.llm.nearest_time import instant, nearest_in_time

T0 = datetime(2026, 6, 1, tzinfo=timezone.utc)


def frames(spark, left, right):
    a = spark.createDataFrame(left, "k long, e string, t timestamp, d string")
    b = spark.createDataFrame(right, "d string, e string, t timestamp")
    return a, b


def pair(a, b, tolerance=3600, **options):
    found = nearest_in_time(a, b, "k", "e", "t", "d", "e", "t", tolerance, **options)
    return sorted((r.row_id, r.match_id, r.distance_us) for r in found.collect())


def brute(left, right, tolerance):
    out = []
    for k, e, t, _ in left:
        near = [(abs(t - u), u, d) for d, f, u in right if None not in (t, u, e, f, d) and e == f and abs(t - u) <= timedelta(seconds=tolerance)] if t else []
        if near and k is not None:
            gap, _, d = min(near)
            out.append((k, d, gap // timedelta(microseconds=1)))
    return sorted(out)


@pytest.mark.parametrize("cell_rows, group_rows", [(100_000, 100_000), (5, 100_000), (40, 10), (5, 7)])
def test_against_brute_force(spark, cell_rows, group_rows):
    rng = random.Random(3)
    moment = lambda: T0 + timedelta(seconds=rng.randrange(400_000))
    left = [(i, rng.choice("AAAAB"), moment(), "x") for i in range(300)]
    right = [(f"q{i}", rng.choice("AAB"), moment()) for i in range(60)]
    left += left[:20] * 2
    assert pair(*frames(spark, left, right), tolerance=7200, cell_rows=cell_rows, group_rows=group_rows) == brute(left, right, 7200)


def test_a_cell_of_many_right_rows_is_many_groups(spark):
    """A million quakes in one zone and day are split by their hash, and the nearest of all parts is found."""
    b = spark.range(1_000_000).select(F.concat(F.lit("q"), "id").alias("d"), F.lit("A").alias("e"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") * F.lit(0.05))).alias("t"))
    times = [T0 + timedelta(seconds=s) for s in (0, 10.01, 49_999.94, 60_000)]
    a = spark.createDataFrame([(i, "A", t, "x") for i, t in enumerate(times)] + [(0, "A", times[0], "x")], "k long, e string, t timestamp, d string")
    found = nearest_in_time(a, b, "k", "e", "t", "d", "e", "t", 3600, cell_rows=50_000, group_rows=50_000)
    got = sorted((r.row_id, r.match_id, r.distance_us) for r in found.collect())
    assert got == [(0, "q0", 0), (0, "q0", 0), (1, "q200", 10_000), (2, "q999999", 10_000)]


def test_ties_border_nulls_and_repeats(spark):
    h = timedelta(hours=1)
    left = [(1, "A", T0, "z"), (1, "A", T0, "z"), (2, "A", T0 + 3 * h, "z"), (3, None, T0, "z"), (4, "A", None, "z"), (5, "B", T0, "z"), (None, "A", T0, "z")]
    right = [("late", "A", T0 + h), ("b", "A", T0 - h), ("a", "A", T0 - h), (None, "A", T0), ("n", None, T0), ("u", "A", None), ("far", "B", T0 + h + timedelta(microseconds=1))]
    # At equal distance the earlier, at one instant the smaller id; the tolerance is inclusive; repeated rows each give one.
    assert pair(*frames(spark, left, right)) == [(1, "a", 3_600_000_000), (1, "a", 3_600_000_000)]


def test_empty_tables(spark):
    a, b = frames(spark, [], [])
    assert pair(a, b) == []
    full = frames(spark, [(1, "A", T0, "z")], [("q", "A", T0)])
    assert pair(full[0], b) == [] and pair(a, full[1]) == []
    assert pair(*full) == [(1, "q", 0)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-06-02T13:15:17Z", "2026-06-02T13:15:17"), ("2022-07-26T02:37:10-05:00", "2022-07-26T07:37:10"), ("2026-06-11T07:20:54+00:00", "2026-06-11T07:20:54"),
        ("Fri, 03 Jul 2026 11:01:54 GMT", "2026-07-03T11:01:54"), ("20260602T082358Z", "2026-06-02T08:23:58"), (" 2026-06-02 08:23:58 UTC ", "2026-06-02T08:23:58"),
        ("3 Jul 2026 11:01:54 +0200", "2026-07-03T09:01:54"), ("2026-06-02T13:15:17.25Z", "2026-06-02T13:15:17.250000"),
        ("2026-07-28 09:49:15", None), ("2026-07-25", None), ("2026-02-30T00:00:00Z", None), ("2026-06-02T25:00:00Z", None), ("", None), (None, None), ("Fri, 03 Foo 2026 11:01:54 GMT", None),
    ],
)
def test_instants(spark, text, expected):
    got = spark.createDataFrame([(text,)], "s string").select(F.date_format(instant(F.col("s")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t")).first().t
    assert got == (expected if expected is None or "." in expected else expected + ".000000")
