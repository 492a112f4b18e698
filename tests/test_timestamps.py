import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from stamp_reference import ref  # noqa: E402

from palimpsest.operators import timestamps as ts  # noqa: E402

DATA = "/root/testdata/sf0.001"
STORES = "store_id string, home_zone string, date_order string, weights string"


def run(spark, values, stores=None):
    stores = stores or [("b", "Europe/Berlin", "dmy", "x"), ("n", "America/New_York", "mdy", "x"), ("l", "Australia/Lord_Howe", "dmy", "x")]
    df = spark.createDataFrame([(i, s, v, "x", "y") for i, (s, v) in enumerate(values)], "no bigint, store_id string, v string, kind string, _v string")
    out = ts.normalise(df, ["v"], spark.createDataFrame(stores, STORES), ["no"]).collect()
    return {r.no: (r.kind, r.norm) for r in out}


CASES = [
    ("b", "2025-03-30 02:30", "gap", ""),
    ("b", "2025-10-26 02:30", "ambiguous", ""),
    ("b", "2025-10-26 02:30:00+02:00", "instant", "2025-10-26T00:30:00.000000Z"),
    ("l", "2025-04-06 01:45", "ambiguous", ""),
    ("l", "2025-10-05 02:15", "gap", ""),
    ("n", "03/04/2025", "day", "2025-03-04"),
    ("b", "03/04/2025", "day", "2025-04-03"),
    ("b", " 20250102 ", "day", "2025-01-02"),
    ("b", "20251301", "none", ""),
    ("b", "1712957375000000", "instant", "2024-04-12T21:29:35.000000Z"),
    ("b", "1712957375123", "instant", "2024-04-12T21:29:35.123000Z"),
    ("b", "17129573751", "none", ""),
    ("b", "2024-02-30", "none", ""),
    ("b", "2024-060", "day", "2024-02-29"),
    ("b", "2023-366", "none", ""),
    ("b", "2024-W01-1", "day", "2024-01-01"),
    ("b", "2024-W53-1", "none", ""),
    ("b", "Mon, 01 Jul 2024 12:00:00 +0900", "instant", "2024-07-01T03:00:00.000000Z"),
    ("b", "Jan 5, 2025 12:01 a.m.", "instant", "2025-01-04T23:01:00.000000Z"),
    ("b", "Jan 5, 2025 13:01 pm", "none", ""),
    ("b", "2024-07-10t21:35:18.8089999z ", "instant", "2024-07-10T21:35:18.808999Z"),
    ("b", "2024-07-10 21:35 Nowhere/Land", "none", ""),
    ("n", "2025-06-20T17:34:39 America/New_York", "instant", "2025-06-20T21:34:39.000000Z"),
    ("b", "2025-06-20 5:34 pm Asia/Tokyo", "instant", "2025-06-20T08:34:00.000000Z"),
    ("b", "2025-06-20 05:34 Pacific/Apia", "instant", "2025-06-19T16:34:00.000000Z"),
    ("n", "25/12/2025", "none", ""),
    ("b", "next sprint", "none", ""),
    ("b", "2024-07-10 " + "x" * 200_000, "none", ""),
    ("?", "2024-07-10 21:35", "ambiguous", ""),
    ("?", "2024-07-10 21:35Z", "instant", "2024-07-10T21:35:00.000000Z"),
]


def test_cases(spark):
    got = run(spark, [c[:2] for c in CASES])
    assert [got.get(i) for i in range(len(CASES))] == [c[2:] for c in CASES]


def test_null_empty_and_blank_give_no_row(spark):
    assert run(spark, [("b", None), ("b", ""), ("b", " \t  ")]) == {}


def test_empty_table(spark):
    df = spark.createDataFrame([], "no bigint, store_id string, v string")
    assert ts.normalise(df, ["v"], spark.createDataFrame([], STORES), ["no"]).count() == 0


def test_order_is_learnt_where_none_is_declared(spark):
    values = [("u", f"{d}/01/2025") for d in range(13, 29)] + [("u", "03/04/2025")]
    values += [("w", f"{m}/{d}/2025") for m in range(1, 3) for d in range(13, 29)] + [("w", "03/04/2025")]
    values += [("z", "03/04/2025"), ("z", "05/05/2025")]
    got = run(spark, values, [(s, "UTC", None, "x") for s in "uwz"])
    assert got[16] == ("day", "2025-04-03")
    assert got[16 + 33] == ("day", "2025-03-04")
    assert got[50] == ("ambiguous", "")  # nothing tells the orders apart
    assert got[51] == ("day", "2025-05-05")  # both orders say the same


def test_declared_order_outweighs_many_values_of_the_other(spark):
    values = [("n", f"{d}/01/2025") for d in range(13, 29)] * 20 + [("n", "03/04/2025")]
    got = run(spark, values)
    assert got[len(values) - 1] == ("day", "2025-03-04")
    assert {got[i] for i in range(len(values) - 1)} == {("none", "")}


@pytest.mark.skipif(not os.path.exists(DATA), reason="test data")
def test_against_plain_reading(spark):
    m = spark.read.parquet(f"{DATA}/memories.parquet")
    s = spark.read.parquet(f"{DATA}/stores.parquet")
    fields = ["created", "last_accessed", "expires"]
    got = {(r.mem_no, r.field): (r.kind, r.norm) for r in ts.normalise(m, fields, s, ["mem_no"]).collect()}
    want = {}
    for r in m.join(s, "store_id").collect():
        for f in fields:
            if r[f]:
                want[r.mem_no, f] = ref(r[f], r.home_zone, r.date_order)
    assert got == want
