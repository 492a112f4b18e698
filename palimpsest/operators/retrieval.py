"""Retrieval over many queries in one plan: BM25, phrase ranks, fusion, link expansion, packing.

Corpora are (doc, text) and queries (query_no, query). Postings are restricted to the queries' terms before
they are shuffled, so the shuffle is as large as the matches, not as the corpus.

Defined results: null texts have no tokens and count as documents of length 0; queries without tokens
give no rows; equal scores are ordered by document; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.sources.tables import cut

#: Characters of all phrases together that are broadcast to the matching tasks.
BROADCAST_CHARS = 8_000_000

#: Terms of all queries together that are broadcast, each with its query.
BROADCAST_TERMS = 500_000

#: Characters of a text that ride along with each of its trigrams.
TAIL = 64


#: The share of score that relations of no known weight pass on.
UNKNOWN_WEIGHT = 0.5


def query_terms(queries: DataFrame) -> DataFrame:
    """query_no, term, repeats."""
    return (
        queries.select("query_no", F.explode(tx.tokens(F.col("query"))).alias("term"))
        .groupBy("query_no", "term")
        .agg(F.count("*").alias("repeats"))
    )


def bm25(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` best documents of every query: query_no, doc, score, rank (k1 = 1.5, b = 0.75)."""
    return top(bm25_scores(corpus, queries), k)


def bm25_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_no, doc, score of all documents that share a term with a query."""
    tokens = corpus.select("doc", F.coalesce(tx.tokens(F.col("text")), F.array()).alias("tokens"))
    stats = tokens.agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("avg_len"))
    asked = query_terms(queries)
    # What the queries ask is small as a rule and terms are skewed, so it is counted and broadcast below a bound.
    small = F.broadcast if asked.count() <= BROADCAST_TERMS else lambda df: df
    terms = small(asked.select("term").distinct())
    postings = (
        tokens.select("doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("term", "doc", "len")
        .agg(F.count("*").alias("f"))
    )
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n, d, f = F.col("docs"), F.col("df"), F.col("f")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    weight = idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    # Weights are rounded, so that the sum does not depend on the order of its terms.
    scored = postings.join(small(df), "term").crossJoin(F.broadcast(stats)).select(
        "term", "doc", F.round(weight, 6).cast("decimal(28,6)").alias("w")
    )
    scores = (
        scored.join(small(asked), "term")
        .groupBy("query_no", "doc")
        .agg(F.sum(F.col("w") * F.col("repeats").cast("decimal(6,0)")).alias("score"))
    )
    return scores.withColumn("score", F.col("score").cast("double"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The `k` best of each query by score, then document; ranks limit the rows before the shuffle."""
    w = Window.partitionBy("query_no").orderBy(F.col("score").desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrase_counts(corpus: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc, phrase, f, len: overlapping occurrences of each phrase of 3 or more characters.

    All phrases are found in one pass over each document by an automaton; their total size is checked
    before they are broadcast, and beyond the bound the corpus is exploded to trigrams instead, of which
    each phrase needs its first.
    """
    wanted = phrases.where(F.length("phrase") >= 3).select("phrase").distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]
    doc_type = corpus.schema["doc"].dataType.simpleString()
    low = corpus.select("doc", F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    if chars > BROADCAST_CHARS:
        grams = low.select("doc", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1)))).alias("i"))
        grams = grams.select(
            "doc", "i", F.substr("text", F.col("i"), F.lit(3)).alias("gram"), F.substr("text", F.col("i"), F.lit(TAIL)).alias("tail"), F.length("text").alias("len")
        )
        first = wanted.select("phrase", F.substring("phrase", 1, 3).alias("gram"), F.substring("phrase", 1, TAIL).alias("head"))
        hits = grams.join(first, "gram").where(F.startswith("tail", "head")).select("doc", "phrase", "len", "i")
        # Phrases longer than the tail are compared to their end with the text itself, where their head was found.
        long = F.length("phrase") > TAIL
        whole = hits.where(long).join(low, "doc").where(F.substr("text", F.col("i"), F.length("phrase")) == F.col("phrase"))
        found = hits.where(~long).unionByName(whole.select("doc", "phrase", "len", "i"))
        return found.groupBy("doc", "phrase", "len").agg(F.count("*").alias("f"))
    shared = corpus.sparkSession.sparkContext.broadcast([r[0] for r in wanted.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in shared.value:
            a.add_word(p, p)
        if len(a):
            a.make_automaton()
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc"], pdf["text"]):
                seen: dict[str, int] = {}
                for _, p in a.iter(t) if len(a) else ():
                    seen[p] = seen.get(p, 0) + 1
                out += [(d, p, n, len(t)) for p, n in seen.items()]
            yield pd.DataFrame(out, columns=["doc", "phrase", "f", "len"])

    return low.mapInPandas(run, f"doc {doc_type}, phrase string, f bigint, len int")


def phrase_rank(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` best documents of every query by the trigram index's rank (k1 = 1.2, b = 0.75)."""
    return top(phrase_scores(corpus, queries), k)


def phrase_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_no, doc, score of all documents that hold a phrase of a query."""
    asked = queries.select("query_no", F.explode(tx.phrases(F.col("query"))).alias("phrase"))
    counts = phrase_counts(corpus, asked)
    trigrams = F.greatest(F.length(F.coalesce("text", F.lit(""))) - 2, F.lit(0))
    stats = corpus.agg(F.count("*").alias("docs"), F.avg(trigrams).alias("avg_len"))
    df = counts.groupBy("phrase").agg(F.count("*").alias("df"))
    n, d, f = F.col("docs"), F.col("df"), F.col("f")
    idf = F.log((n - d + 0.5) / (d + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    length = F.greatest(F.col("len") - 2, F.lit(0))
    weight = idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / F.col("avg_len")))
    scored = counts.join(df, "phrase").crossJoin(F.broadcast(stats)).select(
        "phrase", "doc", F.round(weight, 6).cast("decimal(28,6)").alias("w")
    )
    scores = scored.join(asked, "phrase").groupBy("query_no", "doc").agg(F.sum("w").alias("score"))
    return scores.withColumn("score", F.col("score").cast("double"))


def short_dense(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_no, doc, hits: how many of a query's dense tokens below three characters a document holds, repeats included.

    Such a token stands in a text where it is one of its pairs, or one of its single characters, so texts and
    queries meet by a join on tokens.
    """
    asked = query_terms(queries).where((F.length("term") < 3) & F.col("term").rlike(f"^[{tx.DENSE}]"))
    singles = F.regexp_extract_all(F.col("text"), F.lit(f"([{tx.DENSE}])"), 1)
    held = corpus.select("doc", F.explode(F.array_distinct(F.concat(tx.tokens(F.col("text")), singles))).alias("term"))
    held = held.join(asked.select("term").distinct(), "term", "left_semi")
    return held.join(asked, "term").groupBy("query_no", "doc").agg(F.sum("repeats").alias("hits"))


def candidates(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` best candidates of every query: query_no, doc, lane, score, rank.

    `corpus` has doc, text, strength. A query that the index answers at all (by phrases or by short dense tokens, each
    raised by a thousandth of the strength) takes those candidates only; the others fall back on BM25.
    """
    phrase = phrase_scores(corpus, queries).select("query_no", "doc", F.col("score").alias("phrase"))
    short = short_dense(corpus, queries)
    strength = corpus.select("doc", F.coalesce("strength", F.lit(0)).alias("strength"))
    both = phrase.join(short, ["query_no", "doc"], "full").join(strength, "doc")
    bonus = F.col("strength") / 1000
    score = F.coalesce(F.col("phrase") + bonus, F.lit(0.0)) + F.coalesce(F.col("hits") + bonus, F.lit(0.0))
    indexed = both.select("query_no", "doc", F.lit("indexed").alias("lane"), F.round(score, 6).alias("score"))
    answered = indexed.select("query_no").distinct()
    rest = bm25_scores(corpus.select("doc", "text"), queries).join(answered, "query_no", "left_anti").where(F.col("score") > 0)
    return top(indexed.unionByName(rest.select("query_no", "doc", F.lit("bm25").alias("lane"), "score")), k)


def fuse(lanes: dict[str, DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lanes (query_no, doc, rank): query_no, doc, score, rank, and each lane's rank."""
    rows = None
    for name, lane in lanes.items():
        one = lane.select("query_no", "doc", "rank", F.lit(name).alias("lane"))
        rows = one if rows is None else rows.unionByName(one)
    ranks = [F.max(F.when(F.col("lane") == n, F.col("rank"))).alias(f"{n}_rank") for n in lanes]
    fused = rows.groupBy("query_no", "doc").agg(
        F.round(F.sum(F.round(1 / (constant + F.col("rank")), 12).cast("decimal(20,12)")).cast("double"), 10).alias("score"), *ranks
    )
    return top(fused, k)


def expand(found: DataFrame, edges: DataFrame, weights: DataFrame, cap_ratio: float = 0.8) -> DataFrame:
    """One hop along links: query_no, doc, base, boost, score.

    Each found document passes score times the relation's weight to the documents it links to; what one
    document receives is capped at `cap_ratio` of the query's best score. Relations of weight 0 pass nothing, relations
    without a weight `UNKNOWN_WEIGHT`.
    """
    best = found.groupBy("query_no").agg((F.max("score") * cap_ratio).alias("cap"))
    passed = (
        found.select("query_no", F.col("doc").alias("src"), "score")
        .join(edges, "src")
        .join(weights, "rel", "left")
        .withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)))
        .where(F.col("weight") > 0)
        .groupBy("query_no", F.col("dst").alias("doc"))
        .agg(F.sum(F.round(F.col("score") * F.col("weight"), 12).cast("decimal(28,12)")).cast("double").alias("sum"))
    )
    both = found.select("query_no", "doc", F.col("score").alias("base")).join(passed, ["query_no", "doc"], "full").join(best, "query_no")
    boost = F.least(F.coalesce("sum", F.lit(0.0)), "cap")
    return both.select(
        "query_no",
        "doc",
        F.coalesce("base", F.lit(0.0)).alias("base"),
        F.round(boost, 9).alias("boost"),
        F.round(F.coalesce("base", F.lit(0.0)) + boost, 9).alias("score"),
    )


def expand_hops(
    found: DataFrame, edges: DataFrame, weights: DataFrame, hops: int = 2, sources: int = 10, decay: float = 0.5, cap_ratio: float = 0.8
) -> DataFrame:
    """Hops along links from the `sources` best of every query: query_no, doc, score, hop, contradicts_with.

    In hop h (from 0) a document passes score times weight times decay^h; what a document receives in all is capped at
    `cap_ratio` of the query's best score. A document that was not found before is a source of the next hop, with what
    its first link, in the order of its sources, gave it. `contradicts` passes nothing but brings its target in; `contradicts_with` lists a document's
    contradicting neighbours among the sources. One row per query and document reached in every hop.
    """
    cap = found.groupBy("query_no").agg((F.max("score") * cap_ratio).alias("cap"))
    rel = edges.join(F.broadcast(weights), "rel", "left").withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)))
    rel = rel.where((F.col("weight") > 0) | (F.col("rel") == "contradicts"))
    none = F.array().cast("array<string>")
    all_ = found.select("query_no", "doc", F.col("score").alias("base"), F.lit(0.0).alias("boost"), F.lit(0).alias("hop"), none.alias("contradicts_with"))
    place = F.lpad(F.col("rank").cast("string"), 6, "0")
    frontier = found.where(F.col("rank") <= sources).select("query_no", F.col("doc").alias("src"), "score", place.alias("key"))
    for h in range(hops):
        part = F.when(F.col("rel") == "contradicts", 0.0).otherwise(F.round(F.col("score") * F.col("weight") * decay**h, 12))
        key = F.concat_ws("|", "key", "rel")
        passed = (
            frontier.join(rel, "src")
            .groupBy("query_no", F.col("dst").alias("doc"))
            .agg(
                F.sum(part.cast("decimal(28,12)")).cast("double").alias("sum"),
                F.array_sort(F.collect_set(F.when(F.col("rel") == "contradicts", F.col("src").cast("string")))).alias("against"),
                F.min_by(part, key).alias("first"),
                F.min(key).alias("key"),
            )
        )
        both = all_.join(passed, ["query_no", "doc"], "full").join(cap, "query_no")
        if h + 1 < hops:
            new = both.where(F.col("hop").isNull())
            at = F.concat_ws("|", "key", F.lpad(F.col("doc").cast("string"), 20, "0"))
            frontier = cut(new.select("query_no", F.col("doc").alias("src"), F.least("first", "cap").alias("score"), at.alias("key")))
        all_ = both.select(
            "query_no",
            "doc",
            F.coalesce("base", F.lit(0.0)).alias("base"),
            F.least(F.coalesce("boost", F.lit(0.0)) + F.coalesce("sum", F.lit(0.0)), "cap").alias("boost"),
            F.coalesce("hop", F.lit(h + 1)).alias("hop"),
            F.array_sort(F.array_union(F.coalesce("contradicts_with", none), F.coalesce("against", none))).alias("contradicts_with"),
        )
    return all_.select("query_no", "doc", F.round(F.col("base") + F.col("boost"), 9).alias("score"), "hop", "contradicts_with")


def stale_last(found: DataFrame, stale: DataFrame) -> DataFrame:
    """`found` (query_no, doc, rank) with `warned` and a new rank: documents of `stale` (doc) come after all others."""
    marked = found.join(stale.select("doc").distinct().withColumn("_w", F.lit(True)), "doc", "left")
    warned = F.coalesce("_w", F.lit(False))
    w = Window.partitionBy("query_no").orderBy(warned, "rank")
    return marked.select("query_no", "doc", F.col("rank").alias("old_rank"), warned.alias("warned"), F.row_number().over(w).alias("rank"))


def pack_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Greedy packing of ranked items under a token budget: query_no, doc, rank, cost, status.

    Items are taken in order of rank; one that does not fit is passed over and later ones still may. The
    fold runs over one query's ranked list, which its caller bounds by the k of the ranking.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", "doc", "cost")))
    folded = ranked.groupBy("query_no").agg(items.alias("items")).withColumn(
        "state",
        F.expr(
            f"""aggregate(items, named_struct('used', 0L, 'taken', cast(array() as array<boolean>)),
            (s, x) -> named_struct(
              'used', s.used + if(s.used + x.cost <= {int(budget)}L, x.cost, 0L),
              'taken', concat(s.taken, array(s.used + x.cost <= {int(budget)}L))))"""
        ),
    )
    rows = folded.select("query_no", F.explode(F.arrays_zip("items", F.col("state.taken").alias("taken"))).alias("x"))
    return rows.select(
        "query_no",
        "x.items.doc",
        "x.items.rank",
        "x.items.cost",
        F.when(F.col("x.taken"), "selected").otherwise("budget").alias("status"),
    )


def recall(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query: query_no, expected, hits within `k`, recall, reciprocal rank of the first hit.

    `expected`: query_no, doc. Queries without a find count with 0.
    """
    joined = expected.distinct().join(found.where(F.col("rank") <= k), ["query_no", "doc"], "left")
    return joined.groupBy("query_no").agg(
        F.count("*").alias("expected"),
        F.count("rank").alias("hits"),
        F.round(F.count("rank") / F.count("*"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def rerank(found: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """`found` with its first 2 * `top_n` rows of each query in the order of another score.

    `scores`: query_no, doc, rerank_score. The rows change places among themselves only; without a
    score, or where all scores are 0, a row keeps its place behind the scored ones in the old order.
    """
    w = Window.partitionBy("query_no").orderBy(
        F.when(F.col("rank") <= 2 * top_n, 0).otherwise(1),
        F.when(F.col("rank") <= 2 * top_n, F.coalesce("rerank_score", F.lit(0.0))).desc_nulls_last(),
        "rank",
    )
    return found.join(scores, ["query_no", "doc"], "left").select(
        "query_no", "doc", F.col("rank").alias("old_rank"), F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"),
        F.row_number().over(w).alias("rank"),
    )


def overlap(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` documents of every query with most of its distinct tokens: query_no, doc, score, rank."""
    asked = query_terms(queries).select("query_no", "term")
    held = corpus.select("doc", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    scores = held.join(asked, "term").groupBy("query_no", "doc").agg(F.count("*").alias("score"))
    return top(scores, k)
