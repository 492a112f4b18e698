import random

from palimpsest.llm import splitting as s
from palimpsest.llm.tokens import encoding

SCHEMA = "doc_id bigint, text string, key string, piece string, n_tokens int"


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in s.split(df, **kw).collect():
        out.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def check(text, pieces, limit, overlap):
    enc = encoding()
    assert pieces[0].char_start == 0 and pieces[-1].char_end == len(text)
    assert [p.piece_no for p in pieces] == list(range(len(pieces)))
    for p in pieces:
        assert p.piece == text[p.char_start : p.char_end]
        assert len(enc.encode_ordinary(p.piece)) <= limit and p.n_tokens <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert a.char_start < b.char_start <= a.char_end < b.char_end
        assert overlap <= b.shared_tokens <= overlap + 3


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma,", "delta.", "修复", "错误。", "\n\n", "\r\n", "  ", "émigré", "x1_y2", "👍", "—"]
    prose = " ".join(rng.choice(words) for _ in range(4000))
    return [prose, "错" * 3000, "abcdefgh" * 2000, "👍" * 1500, "\n" * 5000, "a b. " * 2000, "word\n\n" * 900, "<|endoftext|> " * 400]


def test_every_text_is_covered_within_the_limit(spark):
    t = texts()
    for limit, overlap in ((512, 64), (40, 8), (64, 0)):
        got = run(spark, t, limit=limit, overlap=overlap)
        for i, text in enumerate(t):
            check(text, got[i], limit, overlap)


def test_small_null_and_empty(spark):
    assert run(spark, [None, "", "short", "a" * 400]) == {}
    kept = run(spark, [None, "", "short"], keep_small=True)
    assert {k: [p.piece for p in v] for k, v in kept.items()} == {2: ["short"]}


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "a b. " * 800), (1, "a b. " * 800)], "doc_id bigint, text string")
    counts = s.split(df).groupBy("piece_no").count().collect()
    assert {r["count"] for r in counts} == {2}


def test_cuts_are_natural_where_there_are_any(spark):
    text = ("one two three four five. " * 30 + "\n\n") * 20
    got = run(spark, [text])[0]
    assert {p.cut_at for p in got[:-1]} <= {"paragraph", "sentence", "line"}


def test_doubling_equals_the_step_by_step_walk():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.array([700, 90, 301])
    whole = rng.random(sizes.sum()) < 0.9
    grade = np.where(whole, rng.integers(0, 6, sizes.sum()), -1)
    for f in np.concatenate(([0], np.cumsum(sizes)[:-1])):
        whole[f] = True
    whole[np.cumsum(sizes) - 1] = True
    limit = np.full(sizes.sum(), 50)
    cuts, begins = s.cut(sizes, whole, grade, limit, 7)
    assert len(cuts) == len(begins)
    assert (cuts - begins <= 50).all() and set(np.cumsum(sizes) - 1) <= set(cuts.tolist())
    assert (np.diff(cuts) > 0).all()
