import random
import re

from palimpsest.llm import leakage

W = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def data():
    rng = random.Random(9)
    vocab = ["otter", "lamp", "of", "the", "x", "42", "Straße", "río", "修", "复", "gate", "a"]
    items = [(f"s{i}", " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 11, 12, 30])))) for i in range(25)]
    items += [("same1", items[3][1]), ("zh", "关于重建索引的交接说明等待很久"), ("none", None), ("empty", "")]
    docs = []
    for i in range(120):
        t = " ".join(rng.choice(vocab) for _ in range(60))
        if i % 3 == 0:
            w = W.findall(rng.choice(items[:25])[1])
            k = rng.choice([10, 11, 12, 20])
            t = t[:90] + "!! " + " ,".join(x.upper() for x in w[:k]) + " -- " + t[90:]
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "x关于重建索引的交接说明等待很久y"), (203, "lamp " * 60_000), (204, items[3][1]), (204, items[3][1])]
    return docs, items


def brute(docs, items, n=12):
    out = set()
    index = {}
    for i, t in items:
        w = W.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            index.setdefault(tuple(w[k : k + n]), set()).add(i)
    for d, t in docs:
        w = W.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + n]), ())}
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "c", 0) for x in docs], "doc_id bigint, text string, key string, pos int")
    return d, spark.createDataFrame([(*x, "c") for x in items], "id string, text string, item string")


def test_both_plans_against_brute_force(spark):
    docs, items = data()
    d, s = frames(spark, docs, items)
    want = brute(docs, items)
    assert want and (202, "zh") in want
    for bound in (leakage.BROADCAST_GRAMS, 0):
        got = [tuple(r) for r in leakage.leaks(d, s, broadcast_grams=bound).select("doc_id", "seed_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_run_is_the_longest_passage(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d, s = frames(spark, [(1, "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y")], [("s", text)])
    assert [tuple(r) for r in leakage.leaks(d, s).select("doc_id", "seed_id", "run").collect()] == [(1, "s", 20)]


def sellers(pattern, text):
    """Least edits of `pattern` against any stretch of `text`."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["otter", "lamp", "of", "gates", "x", "42", "straße", "río", "修", "复", "anchor", "a", "ledger", "slow"]
    items = [(f"s{i}", " ".join(rng.choice(vocab) for _ in range(rng.choice([12, 20, 26])))) for i in range(12)]
    docs = []
    for n in range(60):
        t = list(" ".join(W.findall(rng.choice(items)[1].lower())))
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(t))
            how = rng.randrange(3)
            t[k : k + 1] = [[], [t[k], rng.choice("zq7")], [rng.choice("zq7")]][how]
        side = " ".join(rng.choice(vocab) for _ in range(8))
        docs.append((n, side + " " + "".join(t) + " " + side))
    for words, edits in ((12, 1), (12, 2), (20, 4)):
        want = {}
        for d, t in docs:
            t = " ".join(W.findall(t.lower()))
            for i, x in items:
                w = W.findall(x.lower())
                least = min((sellers(" ".join(w[k : k + words]), t) for k in range(len(w) - words + 1)), default=99)
                if least <= edits:
                    want[d, i] = least
        assert len(set(want.values())) == edits + 1
        d, s = frames(spark, docs, items)
        for bound in (leakage.BROADCAST_GRAMS, 0):
            got = {(r.doc_id, r.seed_id): r.edits for r in leakage.leaks(d, s, words=words, edits=edits, broadcast_grams=bound).collect()}
            assert got == want


def test_two_words_changed_in_a_passage_of_twenty(spark):
    words = [f"thing{i} of" for i in range(10)]
    text = " ".join(words)
    d, s = frames(spark, [(1, "so " + text.replace("thing3", "thang7").replace("thing8", "zzing8") + " on")], [("s", text)])
    assert leakage.leaks(d, s, words=20, edits=8).first().edits == 4
    assert leakage.leaks(d, s, words=20, edits=3).count() == 0


def test_documents_without_key_are_alike_in_both_plans(spark):
    docs, items = data()
    d, s = frames(spark, [(None if i % 2 else i, t) for i, t in docs], items)
    rows = [{tuple(r) for r in leakage.leaks(d, s, edits=1, broadcast_grams=b).collect()} for b in (leakage.BROADCAST_GRAMS, 0)]
    assert rows[0] == rows[1] and any(r[0] is None for r in rows[0])


def test_edits_widen_the_bands(spark):
    words = [f"word{i}" for i in range(40)]
    broken = words[:13] + ["inserted"] + words[13:26] + ["again"] + words[26:]
    d, s = frames(spark, [(1, " ".join(broken))], [("s", " ".join(words))])
    assert leakage.leaks(d, s, edits=1).first().run >= 13


def test_empty_tables(spark):
    docs, items = data()
    d, s = frames(spark, docs, items)
    none_d, none_s = frames(spark, [], [])
    assert leakage.leaks(none_d, s).count() == 0
    assert leakage.leaks(d, none_s).count() == 0
    assert leakage.leaks(none_d, none_s, broadcast_grams=-1).count() == 0
