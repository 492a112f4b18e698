import random
import re

import pytest

from palimpsest.llm import neardup

W = re.compile(r"[^\W_]+")


def brute(rows, fields, threshold=0.7):
    out = set()
    for f, name in enumerate(fields):
        sets = []
        for r in rows:
            t = " ".join(W.findall((r[1 + f] or "").lower()))
            sets.append((r[0], {t[i : i + 5] for i in range(len(t) - 4)}))
        for i, (a, x) in enumerate(sets):
            for b, y in sets[i + 1 :]:
                if a is not None and b is not None and a != b and x and y and len(x & y) >= threshold * len(x | y) - 1e-12:
                    out.add((min(a, b), max(a, b), name))
    return out


def data():
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("ka", "to", "mi", "ru") for b in ("len", "dor", "xa", "pim") for c in ("s", "ta", "o")] + ["修复", "错误", "索引"]
    rows, n = [], 0
    for size in (1, 2, 3, 8, 25, 60, 140):
        for _ in range(14):
            base = [rng.choice(vocab) for _ in range(size)]
            for edits in (0, 0, 1, max(1, size // 12), max(1, size // 6)):
                w = list(base)
                for _ in range(edits if edits < 2 or size > 1 else 1):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                rows.append((n, " ".join(w).upper() if n % 2 else ",  ".join(w) + "!", w[0] * 3))
                n += 1
    rows += [(n + 1, None, None), (n + 2, "", "  "), (n + 3, "ab!", "a-b-c-"), (n + 4, "ab!", "A b c"), (None, "kalens todors", None)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "no bigint, body string, short string, field string, a int")
    got = [tuple(r) for r in neardup.pairs(df, ("body", "short"), "no", **kw).select("a", "b", "field").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_against_brute_force(spark, bucket_rows):
    rows = data()
    want = brute(rows, ("body", "short"))
    got = run(spark, rows, bucket_rows=bucket_rows)
    assert got <= want
    assert len(want - got) <= 0.002 * len(want)


def test_exact_bands_miss_nothing():
    """Pairs at the very threshold share an entry of the exact bands, at least one side whole, under any allocation."""
    import numpy as np

    rng = random.Random(5)
    for n in (1, 2, 3, 5, 9, 14, 25, 45, 80, 129):
        for _ in range(30):
            base = [rng.getrandbits(44) for _ in range(n)]
            top = int(n / 0.7 + 1e-9)
            other = list(base)
            while True:  # as different as the threshold allows
                new = list(other)
                if rng.random() < 0.5 and len(new) < top:
                    new.append(rng.getrandbits(44))
                else:
                    new[rng.randrange(len(new))] = rng.getrandbits(44)
                if len(set(new) & set(base)) < 0.7 * len(set(new) | set(base)):
                    break
                other = new
            sets = [sorted(set(base)), sorted(set(other))]
            grams = np.array(sets[0] + sets[1], dtype=np.uint64)
            begin = np.array([0, len(sets[0]), len(grams)])
            rec, sig, kind, tag = neardup.exact_entries(grams, begin, 0.7)
            costs = [(t, rng.random() * 9, rng.random() * 9) for t in set(tag.tolist())]
            chosen = neardup.allocation(costs, 0.7)
            index = {}
            for r, x, w, t in zip(rec.tolist(), sig.tolist(), kind.tolist(), tag.tolist()):
                if t in chosen and (w & 1 or chosen[t] == 1):
                    index.setdefault((t, x), {}).setdefault(r, set()).add(w)
            meets = lambda m: len(m) == 2 and any((x | y) & 3 == 3 for x in m[0] for y in m[1])
            assert any(map(meets, index.values())), n


def test_allocation_takes_the_cheapest_segments():
    k, (_, _, bound, segments) = 1, neardup.exact_bands(0.7)[0]
    costs = [(64 + i, 10.0 * i, 100.0 * i) for i in range(1, segments + 1)]
    chosen = {t: v for t, v in neardup.allocation(costs, 0.7).items() if t // 64 == k}
    assert sum(v + 1 for v in chosen.values()) >= bound + 1
    assert all(v == 0 for v in chosen.values()) or segments < bound + 1


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(str(rng.random()) for _ in range(8000))
    rows = [(1, long, None), (2, long[:-200] + "tail", None), (3, long[: len(long) // 2], None)]
    assert run(spark, rows) == {(1, 2, "body")}


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_links_hold_the_same_groups_together_as_all_pairs(spark):
    rows = [r for r in data() if r[0] is not None][::3]
    rows += [(5000 + i, rows[0][1], rows[1][2]) for i in range(6)]
    df = spark.createDataFrame(rows, "no bigint, body string, short string")
    every = neardup.components(neardup.pairs(df, ("body", "short"), "no").select("a", "b").distinct())
    few = neardup.links(df, ("body", "short"), "no")
    assert {tuple(r) for r in neardup.components(few).collect()} == {tuple(r) for r in every.collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 3)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_index_entries_are_not_sorted_as_rows(spark, monkeypatch):
    """They travel in blocks: windows over rows of entries took a fifth of the time."""
    plans, cut = [], neardup.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(neardup, "cut", seen)
    rows = data()[:150]
    assert run(spark, rows) == brute(rows, ("body", "short"))
    assert any("share" in p for p in plans) and not any("Window" in p for p in plans)


@pytest.mark.parametrize("full", [8_000_000, 400])
@pytest.mark.parametrize("bits, split", [(42, 6), (32, 5), (53, 6)])
def test_entries_that_fall_together(monkeypatch, full, bits, split):
    """Blocks and shares give the buckets of a plain grouping, also where a share is put out before its end."""
    import collections

    import numpy as np
    import pandas as pd

    monkeypatch.setattr(neardup, "_FULL", full)
    rng = np.random.default_rng(1)
    tag = np.where(rng.random(3000) < 0.4, rng.integers(1, 605, 3000), 0).astype(np.uint64)
    sig = (rng.integers(0, 1 << bits, 3000).astype(np.uint64) | (tag << np.uint64(53)))[rng.integers(0, 3000, 6000)]
    sig = np.concatenate([sig, np.repeat(sig[:2], 400), rng.integers(0, 1 << bits, 3000).astype(np.uint64)])
    rng.shuffle(sig)
    entry = rng.integers(0, 1 << 40, len(sig))
    entry[:4000] %= 1000
    blocks = pd.concat([neardup._blocks(sig[at], entry[at], bits, split) for at in (slice(0, 4000), slice(4000, None), slice(0, 0))])
    got = []
    for number, own in blocks.groupby("share"):
        share, out = neardup._Share(int(number), bits, split, 100), []
        for _, b in own.iterrows():
            out += share.add([b["base"]], [b["sigs"]], [b["entries"]])
        for batch in [*out, *share.close()]:
            s, e, n, later = (batch.column(c).to_pylist() for c in range(4))
            got += [(*r, x and tuple(x)) for *r, x in zip(s, e, n, later)]
    buckets = collections.defaultdict(list)
    for s, e in zip(sig.tolist(), entry.tolist()):
        buckets[s].append(e)
    want = []
    for s, es in buckets.items():
        es.sort()
        for j, e in enumerate(es):
            if len(es) > 100:
                want.append((s, e, -1, None))
            elif len(es) > 1 and (j < len(es) - 1 or s >> 53):
                want.append((s, e, len(es), tuple(es[j + 1 :]) or []))
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))
    assert sum(w[2] < 0 for w in want) > 700
