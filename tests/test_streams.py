import datetime as dt

import pytest

from palimpsest.plans import stream_queries

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2025, 1, 1)


def rows():
    out = []
    for i in range(600):
        at = START + 37 * (i % 120) * HOUR + (i % 7) * HOUR
        out.append((i, f"t{i % 3}", i % 11, "user", f"x{i % 5}", "h" if i % 4 else None, at))
    out += [(1000 + i, "t0", 0, "user", "x0", "h", None) for i in range(3)] + [(1010 + i, "u", 1, None, None, None, None) for i in range(3)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("turns"))
    schema = "turn_no bigint, transcript string, ord bigint, role string, text string, host string, received_at timestamp"
    spark.createDataFrame(rows(), schema).repartition(40).write.parquet(f"{base}/turns.parquet")  # every file spans all the time
    return base


def test_activity_counts_every_turn(spark, folder):
    import collections

    want = collections.Counter()
    for _, _, _, _, text, host, at in rows():
        if at is not None:
            us = round((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
            at = us - us % (7 * 24 * 3_600_000_000)
        want[at, host or "", "turns"] += 1
        want[at, host or "", "chars"] += len(text or "")
    got = collections.Counter()
    for r in stream_queries.stream_activity(spark, folder).collect():
        got[r.from_us, r.host, "turns"], got[r.from_us, r.host, "chars"] = r.turns, r.chars
    assert +got == +want


def test_turns_once_does_not_depend_on_files(spark, folder):
    import collections

    by = collections.defaultdict(set)
    for _, transcript, o, role, text, _, at in rows():
        by[transcript, o, role, text or ""].add(at)
    want = collections.Counter()
    for (transcript, *_), times in by.items():
        last, n = None, 0
        for at in sorted(t for t in times if t is not None):
            if last is None or at - last >= 48 * HOUR:
                last, n = at, n + 1
        want[transcript] += n or 1
    assert {r.transcript: r.turns for r in stream_queries.stream_turns_once(spark, folder).collect()} == want


def test_empty_source(spark, tmp_path):
    schema = "turn_no bigint, transcript string, ord bigint, role string, text string, host string, received_at timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/turns.parquet")
    assert stream_queries.stream_activity(spark, str(tmp_path)).count() == 0
    assert stream_queries.stream_turns_once(spark, str(tmp_path)).count() == 0
