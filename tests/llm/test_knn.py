import json

import numpy as np
import pytest

from palimpsest.llm import knn

SCHEMA = "vec_no bigint, fingerprint string, dimensions bigint, vector_json string, id string, space string, leaf int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def brute(rows, k=5):
    spaces = {}
    for i, f, d, t in rows:
        v = knn.parse(t, d)
        if v is not None:
            spaces.setdefault((f, d), []).append((i, v))
    out = set()
    for members in spaces.values():
        ids, m = np.array([x[0] for x in members]), np.array([x[1] for x in members])
        c = np.round(m @ m.T, 12)
        for r in range(len(ids)):
            order = [o for o in np.lexsort((ids, -c[r])) if ids[o] != ids[r]][:k]
            out |= {(int(ids[r]), int(ids[o])) for o in order}
    return out


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), d))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * 0.25


def data():
    rows = [(i, "a", 16, json.dumps([round(float(x), 4) for x in v])) for i, v in enumerate(clustered(900, 16, 1))]
    rows += [(1000 + i, None, 8, json.dumps([float(x) for x in v])) for i, v in enumerate(clustered(60, 8, 2))]
    rows += [(2000 + i, "a", 16, rows[5][3]) for i in range(40)]  # copies
    rows += [(3000 + i, "a", 16, json.dumps([x * 3 for x in json.loads(rows[6][3])])) for i in range(3)]  # scaled
    bad = [None, "", "[1,2", "[]", json.dumps([0] * 16), json.dumps([1.0] * 15), "[" + ",".join(["NaN"] * 16) + "]", json.dumps([None] * 16), json.dumps(["1"] * 16), json.dumps([True] * 16), "[1e999" + ",1" * 15 + "]", "{}", "7"]
    rows += [(4000 + i, "a", 16, t) for i, t in enumerate(bad)] + [(4100, "a", None, rows[0][3])]
    return rows


@pytest.mark.parametrize("group_rows", [100, 8192])
def test_recall_against_brute_force(spark, group_rows):
    rows = data()
    got = {(r.id, r.neighbour) for r in knn.neighbours(frame(spark, rows), group_rows=group_rows).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    assert len(got & want) / len(want) >= 0.99
    hot = {b for a, b in got if a == 2039}
    assert hot == {5, 2000, 2001, 2002, 2003}  # copies by id


def test_recall_over_many_leaves(spark):
    rows = [(i, "a", 24, json.dumps([round(float(x), 5) for x in v])) for i, v in enumerate(clustered(4000, 24, 3))]
    rows += [(9000 + i, "a", 24, rows[7][3]) for i in range(300)]
    got = {(r.id, r.neighbour) for r in knn.neighbours(frame(spark, rows), leaf_rows=64, group_rows=50).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    assert len(got & want) / len(want) >= 0.99


def test_wanted_leaves_hold_the_probability():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(4000, knn.M))
    tree = knn.Tree(points, 5)
    at = points[:200]
    who, leaf = tree.wanted(at, np.full(200, 0.3), 0.95)
    wanted = set(zip(who.tolist(), leaf.tolist()))
    near = np.repeat(at, 50, axis=0) + rng.normal(size=(10_000, knn.M)) * 0.3
    hit = [(i // 50, x) in wanted for i, x in enumerate(tree.leaf(near).tolist())]
    assert 0.94 <= np.mean(hit) <= 0.99
    assert len(wanted) < 200 * 32 / 3


def test_few_and_none(spark):
    rows = [(1, "a", 2, "[1,0]"), (2, "a", 2, "[0,1]"), (3, "b", 2, "[1,1]")]
    assert {(r.id, r.neighbour) for r in knn.neighbours(frame(spark, rows)).collect()} == {(1, 2), (2, 1)}
    assert knn.neighbours(frame(spark, [])).count() == 0


def test_brute_force_operator(spark):
    rows = data()[:300]
    df = frame(spark, rows)
    got = {(r.id, r.neighbour) for r in knn.brute_force(df, df.where("vec_no % 20 = 0")).collect()}
    assert got == {p for p in brute(rows) if p[0] % 20 == 0}


def test_chi_square():
    assert abs(knn.chi2_cdf(15.507, 8) - 0.95) < 1e-4
    assert abs(knn.chi2_quantile(0.95, 8) - 15.507) < 1e-3


def test_brute_force_takes_every_query(spark):
    from pyspark.sql import functions as F

    n = 200_300
    asked = spark.range(n).select(
        (F.col("id") + 10).alias("vec_no"), F.lit("a").alias("fingerprint"), F.lit(2).cast("bigint").alias("dimensions"),
        F.concat(F.lit("[1,"), F.col("id").cast("string"), F.lit("]")).alias("vector_json"),
    )
    rows = frame(spark, [(1, "a", 2, "[1,0]"), (2, "a", 2, "[0,1]")])
    got = knn.brute_force(rows, asked, k=1)
    assert got.select("id").distinct().count() == n


def test_brute_force_does_not_depend_on_query_blocks(spark):
    rows = data()[:300]
    df = frame(spark, rows)
    got = {(r.id, r.neighbour) for r in knn.brute_force(df, df.where("vec_no % 20 = 0"), query_bytes=600).collect()}
    assert got == {p for p in brute(rows) if p[0] % 20 == 0}


def test_packed_numbers_come_back_unchanged():
    rng = np.random.default_rng(4)
    many = np.round(rng.normal(size=(40, 48)), 5)
    rows = [many, many * 10, np.round(many, 0) + 1, rng.normal(size=(5, 48)), many * 1e-300, many * 1e300, np.full((1, 48), 1e15 + 1)]
    rows = np.concatenate([*rows, np.round(rng.normal(size=(3, 48)), 9), np.array([[-0.5] + [0.0] * 47])])
    vecs = knn.packed(rows)
    assert (knn.unpacked(vecs) == rows).all()
    assert max(len(v) for v in vecs[:40]) <= 2 + 3 * 48
    assert knn.unpacked([]).size == 0


def test_queries_travel_once_to_a_cell(spark):
    """Bytes shuffled a vector: they grew with the leaves a query asks for, and now with the cells these lie in."""
    rows = [(i, "a", 64, json.dumps([round(float(x), 5) for x in v])) for i, v in enumerate(clustered(6000, 64, 6))]
    df = frame(spark, rows).persist()
    df.count()
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = sent()
    got = {(r.id, r.neighbour) for r in knn.neighbours(df, leaf_rows=64).collect()}
    a_vector = (sent() - before) / len(rows)
    df.unpersist()
    want = brute(rows)
    assert len(got) == len(want)
    assert len(got & want) / len(want) >= 0.99
    assert a_vector < 5_000, a_vector


def test_copies_fill_up_lists(spark):
    """Copies beside other vectors, and repeated rows."""
    rows = [(i, "a", 3, json.dumps([1, round(i / 50, 2), 0])) for i in range(30)]
    rows += [(100 + i, "a", 3, "[2, 0.2, 0]") for i in range(3)]  # of row 5
    rows += [(200, "a", 3, "[0, 0, 1]"), (201, "a", 3, "[0.0, 0.1, 1]")]
    got = [(r.id, r.neighbour, r["rank"]) for r in knn.neighbours(frame(spark, [*rows, rows[-2]])).collect()]
    of = lambda i: [n for a, n, r in sorted(got, key=lambda x: x[2]) if a == i]
    assert {(a, n) for a, n, _ in got} == brute(rows)
    assert of(5)[:3] == [100, 101, 102] and of(101)[:3] == [5, 100, 102]
    assert of(200)[:2] == [201, 201] and sorted(of(200)) == sorted([*set(of(200))] * 2)
