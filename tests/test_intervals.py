import random
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st

from telar.operators.intervals import coverage_report, merge_intervals

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    data = [(k, None if a is None else T0 + timedelta(seconds=a), None if b is None else T0 + timedelta(seconds=b), "x") for k, a, b in rows]
    return spark.createDataFrame(data, "k string, a timestamp, b timestamp, kind string")


def brute(rows):
    out, by = [], {}
    for k, a, b in rows:
        if a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    for k, ranges in by.items():
        merged = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(k, "period", a, b) for a, b in merged] + [(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=str)


def result(df, **options):
    at = lambda t: round((t.replace(tzinfo=timezone.utc) - T0).total_seconds(), 6)
    return sorted(((r.k, r.kind, at(r.start), at(r.end)) for r in merge_intervals(df, ["k"], "a", "b", **options).collect()), key=str)


def same(got, want):
    return [(k, n, float(a), float(b)) for k, n, a, b in got] == [(k, n, float(a), float(b)) for k, n, a, b in want]


def test_against_brute_force(spark):
    rng = random.Random(7)
    for span in (40_000, 4_000_000):
        rows = [(rng.choice(["x", "x", "x", "y", None]), a := rng.randrange(span), a + rng.choice([0, -5, 1, 30, 900, 86_400, 900_000])) for _ in range(600)]
        assert same(result(frame(spark, rows), slice_days=1), brute(rows))
        assert same(result(frame(spark, rows), slice_days=7), brute(rows))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pq"), st.integers(0, 400_000), st.integers(-10, 200_000)), max_size=25))
def test_any_ranges(spark, triples):
    rows = [(k, a, a + n) for k, a, n in triples]
    assert same(result(frame(spark, rows), slice_days=1), brute(rows))


def test_touching_nested_repeated_and_null(spark):
    rows = [("x", 0, 10), ("x", 10, 20), ("x", 2, 5), ("x", 2, 5), ("x", 30, 40), (None, 0, 5), ("x", None, 9), ("x", 9, None), ("x", 50, 50), ("x", 70, 60)]
    assert same(result(frame(spark, rows)), brute(rows))
    assert brute(rows) == sorted([("x", "period", 0, 20), ("x", "gap", 20, 30), ("x", "period", 30, 40), (None, "period", 0, 5)], key=str)
    report = {r.k: r for r in coverage_report(frame(spark, rows), ["k"], "a", "b").collect()}
    assert report["x"].n_gaps == 1 and report["x"].covered_s == 30.0 and report["x"].longest_gap_s == 10.0


def test_long_range_over_many_slices_and_empty(spark):
    rows = [("x", 0, 90 * 86_400), ("x", 86_400, 2 * 86_400), ("x", 91 * 86_400, 92 * 86_400)]
    assert same(result(frame(spark, rows), slice_days=1), brute(rows))
    assert result(frame(spark, [])) == []
