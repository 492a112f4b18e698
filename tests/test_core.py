from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import graph, records, retrieval, turns
from palimpsest.sources import markdown


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column).first()[0]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), "Ab_c 修复错误x É!") == ["ab_c", "修复", "复错", "错误", "x", "é"]
    assert one(spark, tx.tokens(F.col("t")), "字") == ["字"]
    assert one(spark, tx.tokens(F.col("t")), "") == []
    assert one(spark, tx.tokens(F.col("t")), None) is None


def test_phrases(spark):
    assert one(spark, tx.phrases(F.col("t")), "b 修复错误 a 错误 b") == ["a", "b", "修复错", "修复错误", "复错误"]


def test_token_estimate(spark):
    assert one(spark, tx.token_estimate(F.col("t")), "") == 0
    assert one(spark, tx.token_estimate(F.col("t")), "a") == 1
    assert one(spark, tx.token_estimate(F.col("t")), "abcdefgh修复") == 3


def test_expired_reads_exact_days_only(spark):
    day = F.lit("2024-07-01").cast("date")
    for value, want in (("2024-06-30", True), ("2024-07-01", False), (" 2024-06-30", False), ("until v2", False), ("2024-13-01", False), (None, False)):
        assert one(spark, tx.expired(F.col("t"), day), value) is want


def test_credentials(spark):
    for value, want in (("  API_KEY = x", True), ("my api_key = x", False), ("a\npassword: y", True), ("Authorization: Bearer z", True), ("-----BEGIN RSA PRIVATE KEY-----", True)):
        assert one(spark, tx.credential(F.col("t")), value) is want


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string")


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_no int, query string")


def test_bm25_against_plain_sum(spark):
    import math

    texts = ["red fox fox", "red dog", None, "", "green fox and a red fox runs", "修复错误"]
    got = {(r.query_no, r.doc): r.score for r in retrieval.bm25(corpus(spark, texts), queries(spark, ["fox red fox", "", "错误"]), 10).collect()}
    docs = [(t or "").split() if i < 5 else ["修复", "复错", "错误"] for i, t in enumerate(texts)]
    avg = sum(map(len, docs)) / len(docs)
    want = {}
    for q, terms in ((0, ["fox", "red", "fox"]), (2, ["错误"])):
        for d, toks in enumerate(docs):
            s = 0.0
            for t in terms:
                df, f = sum(t in x for x in docs), toks.count(t)
                if f:
                    s += round(math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(toks) / max(avg, 1))), 6)
            if s:
                want[q, d] = round(s, 6)
    assert got == want


def test_phrase_counts_overlap_and_both_plans_agree(spark, monkeypatch):
    c = corpus(spark, ["banana BANANA", "an anan", None, "xx"])
    p = spark.createDataFrame([("ana",), ("nana",), ("xx",)], "phrase string")
    want = {(0, "ana", 4, 13), (0, "nana", 2, 13), (1, "ana", 1, 7)}
    assert {tuple(r) for r in retrieval.phrase_counts(c, p).select("doc", "phrase", "f", "len").collect()} == want
    monkeypatch.setattr(retrieval, "BROADCAST_CHARS", 0)
    assert {tuple(r) for r in retrieval.phrase_counts(c, p).select("doc", "phrase", "f", "len").collect()} == want


def test_long_phrases_are_found_by_both_plans(spark, monkeypatch):
    long, cjk = "identifier_" * 9, "修复错误" * 20
    c = corpus(spark, [f"see {long} and {long}", f"see {long[:-1]}x", cjk * 2, cjk[:-1]])
    p = spark.createDataFrame([(long,), (cjk,), ("see",)], "phrase string")
    want = {(0, long, 2), (2, cjk, 21), (0, "see", 1), (1, "see", 1)}
    for chars in (retrieval.BROADCAST_CHARS, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_CHARS", chars)
        assert {tuple(r) for r in retrieval.phrase_counts(c, p).select("doc", "phrase", "f").collect()} == want


def test_pack_budget_passes_over_what_does_not_fit(spark):
    r = spark.createDataFrame([(1, 10, 1, 50), (1, 11, 2, 60), (1, 12, 3, 40)], "query_no int, doc int, rank int, cost bigint")
    got = {x.doc: x.status for x in retrieval.pack_budget(r, 100).collect()}
    assert got == {10: "selected", 11: "budget", 12: "selected"}


def test_expand_caps_the_boost(spark):
    found = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 0.9, 2)], "query_no int, doc int, score double, rank int")
    edges = spark.createDataFrame([(1, 3, "refines"), (2, 3, "refines"), (1, 2, "supersedes")], "src int, dst int, rel string")
    got = {r.doc: r.score for r in retrieval.expand(found, edges, graph.relations(spark).select("rel", "weight")).collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 0.8}


def test_reach_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x2")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in graph.reach(e, starts, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in graph.on_cycles(e, 5).collect()} == {("a", 3), ("b", 3), ("c", 3)}


def test_cycles_of_any_length(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    pair, tail = [("p", "q"), ("q", "p"), ("q", "r0")], [("t0", "r3"), *[(f"t{i}", f"t{i - 1}") for i in range(1, 8)], ("r5", "e")]
    bridge = [("z", "p"), ("r8", "y"), ("y", "w"), ("w", "y")]
    e = spark.createDataFrame(ring + pair + tail + bridge, "src string, dst string")
    want = {(f"r{i}", 9) for i in range(9)} | {("p", 2), ("q", 2), ("y", 2), ("w", 2)}
    assert {tuple(r) for r in graph.on_cycles(e).collect()} == want
    assert {tuple(r) for r in graph.on_cycles(e, 8).collect()} == {x for x in want if x[1] == 2}


def test_source_identity(spark):
    ev = spark.createDataFrame([(1, "k", "p"), (2, "k", "p"), (3, "k", "q"), (4, None, None), (5, None, None)], "n int, k string, payload string")
    got = {r.n: r.verdict for r in records.source_identity(ev, ["k"], F.col("payload"), "n").collect()}
    assert got == {1: "first", 2: "duplicate", 3: "conflict", 4: "first", 5: "duplicate"}


def test_sync_actions(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "p string, f string")
    b = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "p string, f string")
    assert {tuple(r) for r in records.sync_actions(a, b, ["p"], "f").collect()} == {("a", "delete"), ("b", "update"), ("c", "keep"), ("d", "insert")}


def test_cache_actions_compare_contents(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    v = spark.createDataFrame(
        [("s", "kept", sha("a")), ("s", "changed", sha("old")), ("s", "stale", "stale"), ("s", "gone", sha("a")), ("s", "mixed", sha("a")), ("s", "mixed", "stale"), ("t", "kept", None)],
        "store_id string, path string, content_hash string",
    )
    paths = ["kept", "changed", "stale", "mixed", "new"]
    m = spark.createDataFrame([(i, "s", p, "a") for i, p in enumerate(paths)] + [(9, "s", "kept", "b"), (10, "t", "kept", "a")], "mem_no int, store_id string, path string, search_text string")
    got = {(r.store_id, r.path): r.action for r in records.cache_actions(v, m).collect()}
    assert got == {
        ("s", "kept"): "keep", ("s", "changed"): "update", ("s", "stale"): "update", ("s", "mixed"): "update", ("s", "gone"): "delete",
        ("s", "new"): "insert", ("t", "kept"): "update",
    }


def test_vector_states(spark):
    v = spark.createDataFrame(
        [("s", "p", "h", 2, "[1,2]"), ("s", "p", "stale", 2, "[1,2]"), ("s", "q", "h", 2, "[1,2]"), ("s", "p", "h", 2, "[0,0]"), ("s", "p", "h", 2, "[1,NaN]"), ("s", "p", "h", 2, None)],
        "store_id string, path string, content_hash string, dimensions bigint, vector_json string",
    )
    known = spark.createDataFrame([("s", "p")], "store_id string, path string")
    assert sorted(r.state for r in records.vector_states(v, known).collect()) == ["corrupt", "corrupt", "corrupt", "orphan", "ready", "stale"]


def test_findings(spark):
    t = spark.createDataFrame(
        [("t", 1, 1, "user", "Please don't use tabs"), ("t", 2, 2, "assistant", "Error in x, fixed by y"), ("t", 3, 3, "assistant", "Step 2: error fixed"), ("t", 4, 4, "user", None), ("t", 5, 5, "assistant", "报错了，原因是空值")],
        "transcript string, ord bigint, turn_no bigint, role string, text string",
    )
    assert {(r.turn_no, r.kind) for r in turns.findings(t).collect()} == {(1, "preference"), (2, "pitfall"), (5, "pitfall")}


def test_digest_depends_on_every_turn(spark):
    schema = "transcript string, ord bigint, turn_no bigint, role string, text string"
    base = [("t", i, i, "user", f"x{i}") for i in range(1200)]
    d = lambda rows: turns.digest(spark.createDataFrame(rows, schema)).first().digest
    assert d(base) == d(base[::-1]) != d(base[:-1] + [("t", 1199, 1199, "user", "y")])


def test_markdown_round_trip(spark):
    schema = "mem_no bigint, " + ", ".join(f"{n} {t}" for n, t in markdown.FIELDS) + ", body string, extra map<string,string>"
    full = (1, "i", "t", "s: x", 5, "2024", None, 2, ["a", 'q"'], [("b", "refines")], "c\nd", "", "active", None, "body\n---\nrest", {"k": "v: w"})
    bare = (2, *[None] * len(markdown.FIELDS), None, None)
    df = spark.createDataFrame([full, bare], schema)
    back = {r.mem_no: r for r in markdown.decode(df.select("mem_no", markdown.encode(df).alias("content"))).collect()}
    r = back[1]
    assert (r.id, r.source, r.strength, r.tags, r.links[0].rel, r.canonical_summary, r.injection_summary, r.body, r.extra) == (
        "i", "s: x", 5, ["a", 'q"'], "refines", "c\nd", "", "body\n---\nrest", {"k": "v: w"},
    )
    assert back[2].id is None and back[2].body == ""
