import random

import numpy as np

from palimpsest.llm import packing as p
from palimpsest.llm.tokens import encoding


def rows(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, tokens int")
    return p.pack(df, **kw).collect()


def test_all_items_in_containers_of_the_capacity(spark):
    rng = random.Random(2)
    texts = [" word" * rng.choice([1, 3, 50, 400, 900, 2047, 2048, 2049, 5000]) for _ in range(120)] + [None, "", ""]
    got = rows(spark, texts, block_items=40)
    per_doc, per_bin = {}, {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_bin.setdefault(r.container, []).append(r)
    assert sorted(per_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        n = len(encoding().encode_ordinary(t or ""))
        parts = sorted(per_doc[i], key=lambda r: r.part_no)
        assert sum(r.tokens for r in parts) == n
        assert len(parts) == max(1, -(-n // 2048))
        assert [r.token_start for r in parts] == [2048 * k for k in range(len(parts))]
    for bin_rows in per_bin.values():
        assert sum(r.tokens for r in bin_rows) == bin_rows[0].container_tokens <= 2048
    total = sum(r.tokens for r in got)
    assert len(per_bin) <= -(-total // 2048) * 1.1 + 1


def test_repeated_rows_are_separate_items(spark):
    df = spark.createDataFrame([(7, "a b c")] * 5, "doc_id bigint, text string")
    got = p.pack(df, capacity=4).collect()
    assert len(got) == 5 and len({r.container for r in got}) == 5


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_search_never_loses_and_never_gets_worse():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(0, 60, rng.integers(1, 80))
        start = [[i] for i in range(len(sizes))]  # one bin per item: much to improve
        got = p.improve([list(b) for b in start], sizes, 60)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        fills = [int(sizes[b].sum()) for b in got]
        assert max(fills) <= 60 and len(got) <= len(start)
        assert sum(f * f for f in fills) >= sum(int(s) ** 2 for s in sizes)
        assert len(got) <= -(-int(sizes.sum()) // 60) * 1.5 + 1


def test_best_fit_uses_the_fullest_bin_with_room():
    assert p.best_fit(np.array([6, 5, 4, 3, 2]), 10) == [[0, 2], [1, 3, 4]]


def test_two_for_one_exchange():
    sizes = np.array([3, 4, 6, 2])
    search = p._Search([[0, 1], [2]], sizes, 8)
    search.offer(0, True)
    gain, come, out = search.best(1, True)
    assert (gain, sorted(come[1:]), out) == (1, [0, 1], [2])


def test_search_beats_best_fit_where_items_are_large():
    sizes = np.random.default_rng(1).integers(300, 1101, 4000)
    start = p.best_fit(sizes, 2048)
    assert len(p.improve(start, sizes, 2048)) < len(start)
    got = p.packed(sizes, 2048)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert max(int(sizes[b].sum()) for b in got) <= 2048
    assert len(got) <= 1393


def test_pairwise_start_places_every_item_once():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = rng.integers(0, 50, rng.integers(1, 120))
        got = p.best_pairs(sizes, 50)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert max(int(sizes[b].sum()) for b in got) <= 50


def test_items_without_tokens_stay():
    got = p.improve([[0], [1], [2, 3]], np.array([0, 0, 5, 4]), 10)
    assert sorted(i for b in got for i in b) == [0, 1, 2, 3] and len(got) == 1
    assert p.improve([[0], [1]], np.array([0, 0]), 10) == [[0, 1]]
