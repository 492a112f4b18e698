"""Formats of transcripts, findings in texts, places in groups, and what edge cases give."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import findings, records, retrieval
from palimpsest.operators import turns as tn
from palimpsest.operators.running import placed
from palimpsest.sources import transcripts

LINES = "transcript string, line_no bigint, line string, role string, text string"


def lines(spark, texts):
    rows = [(name, n, line, "x", "y") for name, body in texts.items() for n, line in enumerate(body)]
    return spark.createDataFrame(rows, LINES)


def test_formats_are_told_apart_by_the_first_line_that_decides(spark):
    j = json.dumps
    texts = {
        "a": ["", j({"x": 1}), j({"message": {"role": "user", "content": "hi"}}), "not json", j({"message": {"role": "system", "content": "no"}})],
        "b": [
            j({"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}}),
            j({"type": "response_item", "payload": {"type": "message", "role": "assistant", "channel": "analysis", "content": "hidden"}}),
            j({"type": "response_item", "payload": {"type": "message", "role": "assistant", "recipient": "tool", "content": "hidden"}}),
            j({"type": "other", "payload": {"type": "message", "role": "user", "content": "hidden"}}),
        ],
        "c": [j({"type": "user", "content": "q"}), j({"type": "assistant", "content": "a", "synthetic_reason": "reminder"})],
        "d": [j({"role": "assistant", "text": " 　 padded\n"}), j({"role": "assistant", "text": " "}), j({"role": "tool", "text": "x"})],
        "e": ["before", "[user] first", "goes on", "[assistant] ", "[assistant] second", ""],
        "f": ["no marker", "at all"],
        "g": ["", "  "],
    }
    got = {(r.transcript, r.format, r.role, r.text) for r in transcripts.turns(lines(spark, texts)).collect()}
    assert got == {
        ("a", "claude-jsonl", "user", "hi"), ("b", "codex-jsonl", "assistant", "one\ntwo"), ("c", "grok-jsonl", "user", "q"),
        ("d", "role-jsonl", "assistant", "padded"), ("e", "text", "user", "first\ngoes on"), ("e", "text", "assistant", "second\n"),
        ("f", "text", "assistant", "no marker\nat all"),
    }
    assert transcripts.turns(lines(spark, {})).count() == 0


def test_findings_in_lists_and_blocks(spark):
    good = {"type": "pitfall", "title": "t" * 90, "content": " c ", "importance": "120", "evidence": "e" * 300}
    texts = [
        "x " + json.dumps([good, {"type": "other", "title": "t", "content": "c"}, {"type": "pitfall", "title": " ", "content": "c"}, {"type": "pitfall", "title": "t", "content": "c", "importance": 1.5}]) + " y",
        json.dumps({"findings": [{"type": "pitfall", "title": "u", "content": "c", "importance": -3}]}),
        "no list", "] [", None, "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, t string")
    got = {(r.no, r.position, len(r.title), r.importance, len(r.evidence)) for r in findings.parsed(df, "t", ["pitfall"]).collect()}
    assert got == {(0, 0, 80, 100, 200), (0, 3, 1, 50, 0), (1, 0, 1, 0, 0)}
    text = "- type: pitfall\n**新发现：**\r\n- type: pitfall\n- title: 'one'\n- tags: a\n- content: |\n\n    first\n      more\n\n- type: pitfall\n- title: two\n- content: |\n  x\n**End**\n- type: pitfall\n"
    assert findings.block(text) == [{"type": "pitfall", "title": "one", "content": "\nfirst\n  more"}, {"type": "pitfall", "title": "two", "content": "x"}]
    rows = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "no int, t string")
    assert [(r.no, r.title, r.importance) for r in findings.parsed_blocks(rows, "t", ["pitfall"]).orderBy("position").collect()] == [(1, "one", 50), (1, "two", 50)]


def test_places_and_sums_in_hot_groups(spark):
    rows = [("hot" if i % 3 else None, (i * 37) % 500, i, i % 5 or None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, no int, v int")
    got = {r.no: (r.place, r.before) for r in placed(df, ["g"], [F.col("o"), F.col("no")], F.col("v")).collect()}
    for g in ("hot", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        total = 0
        for n, r in enumerate(own, 1):
            assert got[r[2]] == (n, total)
            total += r[3] or 0
    assert placed(df.limit(0), ["g"], [F.col("o")]).count() == 0


def test_reading_goes_on_only_behind_an_unchanged_beginning(spark):
    schema = "transcript string, ord bigint, turn_no bigint, role string, text string"
    was = [("same", 1, 1, "user", "a"), ("same", 2, 2, None, "b"), ("edited", 1, 3, "user", "a")]
    now = [*was[:2], ("same", 3, 9, "user", None), ("edited", 1, 3, "user", "other"), ("new", 1, 5, "user", "x")]
    got = {tuple(r) for r in tn.resume_points(spark.createDataFrame(was, schema), spark.createDataFrame(now, schema)).collect()}
    assert got == {("same", 2, 3, 2), ("edited", 1, 1, 0), ("new", 0, 1, 0)}


def test_hops_pass_decaying_score_and_mark_contradictions(spark):
    found = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.5, 2)], "query_no int, doc int, score double, rank int")
    edges = spark.createDataFrame(
        [(10, 20, "refines"), (20, 30, "unheard"), (11, 12, "contradicts"), (10, 11, "refines"), (10, 40, "supersedes"), (11, 20, "related")],
        "src int, dst int, rel string",
    )
    weights = spark.createDataFrame([("refines", 0.7), ("contradicts", 0.0), ("supersedes", 0.0), ("related", 0.5)], "rel string, weight double")
    got = {r.doc: (round(r.score, 6), r.hop, r.contradicts_with) for r in retrieval.expand_hops(found, edges, weights).collect()}
    assert got == {
        10: (1.0, 0, []), 11: (1.2, 0, []), 12: (0.0, 1, ["11"]), 20: (0.8, 1, []),  # capped at 0.8 of the best
        30: (round(0.7 * 0.5 * 0.5, 6), 2, []),  # with what the first link gave its source
    }


def test_token_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    base = [sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randrange(1, 12))) for _ in range(30)]
    sets = [(i % 2, i, sorted(set(b) | set(rng.sample("abcdefgh", rng.randrange(2))))) for i, b in enumerate(base * 4)] + [(0, 900, [])]
    df = spark.createDataFrame(sets, "g int, no int, tokens array<string>")
    got = {(r.a, r.b) for r in records.token_pairs(df, ["g"], 0.8).collect()}
    want = set()
    for g, a, x in sets:
        for h, b, y in sets:
            if g == h and a < b and x and y and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) - 1e-9:
                want.add((a, b))
    assert got == want and want
