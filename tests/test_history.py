import random

import pytest

from palimpsest.operators import history as h

SCHEMA = "store_id string, memory_id string, revision bigint, recorded_at string, semantic_hash string, unknown_gap boolean, slice string, n int, hash string"


def rows(spark, data):
    """Rows with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*d, "x", 7, "clash") for d in data], SCHEMA)


def expected(data):
    """The definition, one record at a time."""
    import datetime as dt

    by = {}
    for s, m, rev, at, sh, gap in data:
        if not at or not sh:
            continue
        try:
            t = dt.datetime.fromisoformat(at.replace("Z", "+00:00"))
        except ValueError:
            continue
        us = (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        k = by.setdefault((s, m), {}).setdefault((us, sh.lower()), [None, False])
        k[0] = rev if k[0] is None else k[0] if rev is None else min(k[0], rev)
        k[1] = k[1] or bool(gap)
    out = set()
    for (s, m), obs in by.items():
        seq = sorted(((us, -1 if r is None else r, sh, g) for (us, sh), (r, g) in obs.items()))
        starts = [x for i, x in enumerate(seq) if i == 0 or seq[i - 1][2] != x[2] or x[3]]
        for i, x in enumerate(starts):
            out.add((s, m, x[0], starts[i + 1][0] if i + 1 < len(starts) else -1, x[2], x[3]))
    return out


def result(df):
    return {tuple(r) for r in h.periods(df).select("store_id", "memory_id", "valid_from_us", "valid_until_us", "hash", "gap").collect()}


def test_versions(spark):
    data = [
        ("s", "a", 1, "2024-01-01T00:00:00Z", "AA", None),
        ("s", "a", 1, "2024-01-01T01:00:00+01:00", "aa", True),  # the same instant and hash, with a gap
        ("s", "a", 2, "2024-01-02T00:00:00.1234567Z", "aa", False),  # no change
        ("s", "a", 3, "2024-01-03T00:00:00Z", "bb", False),
        ("s", "a", 4, "2024-01-03T00:00:00Z", "aa", False),  # equal instants, by revision
        ("s", "a", None, "unknown", "cc", False),
        ("s", "a", None, None, "cc", False),
        ("s", "a", None, "2024-01-04T00:00:00Z", None, False),
        ("s", "a", 5, "2024-01-05T00:00:00Z", "aa", True),  # a gap starts a version
        ("s", None, 1, "2024-01-05T00:00:00Z", "zz", None),
        (None, None, 1, "2024-01-05T00:00:00Z", "zz", None),
    ]
    got = result(h.satellite(rows(spark, data)))
    want = {x for x in expected([d for d in data if d[3] != "2024-01-02T00:00:00.1234567Z"])}
    assert got == want


@pytest.mark.parametrize("slice_rows", [3, 10, 10_000])
def test_slices_of_a_hot_record_change_nothing(spark, slice_rows):
    rng = random.Random(5)
    data = []
    for i in range(900):
        m = "hot" if i % 3 else f"m{rng.randrange(40)}"
        at = f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:00:00+0{rng.randrange(4)}:00"
        data.append(("s", m, i, at, f"h{rng.randrange(3)}", rng.random() < 0.05))
    assert result(h.satellite(rows(spark, data), slice_rows=slice_rows)) == expected(data)


def test_empty_table(spark):
    assert result(h.satellite(rows(spark, []))) == set()


def test_append_only_adds_new_rows(spark):
    have = spark.createDataFrame([("s", "a", 1, "x"), (None, "b", 2, "y")], "store_id string, memory_id string, at_us bigint, hash string")
    batch = spark.createDataFrame([("s", "a", 1, "x"), (None, "b", 2, "y"), ("s", "a", 3, "z"), ("s", "a", 3, "z")], have.schema)
    assert [tuple(r) for r in h.append_rows(have, batch).collect()] == [("s", "a", 3, "z")]


def test_as_of(spark):
    data = [("s", "a", 1, "1970-01-01T00:00:01Z", "x", None), ("s", "a", 2, "1970-01-01T00:00:02Z", "y", None)]
    view = h.periods(h.satellite(rows(spark, data)))
    assert [r.hash for r in h.as_of(view, 1_999_999).collect()] == ["x"]
    assert [r.hash for r in h.as_of(view, 2_000_000).collect()] == ["y"]
    assert h.as_of(view, 0).count() == 0


@pytest.mark.parametrize("broadcast_records", [1000, 0])
def test_bursts_are_cut_into_slices_and_either_join_gives_the_same(spark, broadcast_records):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    data = []
    for i in range(400):
        at = "2024-05-01T00:00:00.%06dZ" % rng.randrange(900) if i % 10 else f"20{rng.randrange(10, 24)}-01-01T00:00:00Z"
        data.append((rng.choice("sss") if i % 7 else None, "hot" if i % 3 else f"m{i % 5}", i, at, rng.choice("abc"), rng.random() < 0.1))
    df = h._sliced(h._readable(rows(spark, data), "semantic_hash", ("store_id", "memory_id")), ("store_id", "memory_id"), 20, broadcast_records)
    n = df.where("memory_id = 'hot' and store_id = 's'").groupBy("slice").agg(F.count("*").alias("n")).collect()
    assert len(n) >= 8 and max(r.n for r in n) <= 60
    at = df.where("memory_id = 'hot' and store_id = 's'").groupBy("slice").agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi")).orderBy("slice").collect()
    assert all(x.hi < y.lo for x, y in zip(at, at[1:]))
    assert df.count() == len(data)
    assert result(h.satellite(rows(spark, data), slice_rows=20)) == expected(data)
