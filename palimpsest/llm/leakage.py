"""Held-out evaluation texts inside a corpus.

Both sides are brought to one form: lower case, words (stretches of letters and digits; a character from
U+3400 to U+9FFF is a word of its own) joined by one blank. Then, by the q-gram lemma: a passage of n
characters that occurs in a document with at most e edits shares at least n + 1 - q - q*e of its q-grams with
it, and these lie within e diagonals of each other (a diagonal is the position in the document minus the
position in the item). So shared q-grams are counted in bands of 2e + 1 diagonals that overlap by e; in the bands
that reach the bound, every passage of the item with enough q-grams is verified by banded alignment: the least
edits (characters put in, left out or replaced) of the passage against any stretch of the document in the band.
q is as large as the shortest possible passage and the edit budget allow.

Two plans give the same rows:
  * while the items' q-grams are at most `broadcast_grams`, their sorted hashes are broadcast (checked by
    counting first) and every document is matched where it lies: no shuffle of the corpus;
  * beyond that, q-grams of both sides are joined on their hash by shuffle and counted by group, which
    spreads frequent q-grams with map-side sums, and only the kept documents are read again.

Defined results: null, empty and short texts (fewer than `words` words) match nothing; texts are taken
whole at any length; items with equal texts are each reported; repeated document rows give one row per
(document id, item); extra columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import cut

#: Greatest length of the q-grams, in characters of the common form.
Q = 16
#: Most q-grams of items that are broadcast: some 16 bytes each.
BROADCAST_GRAMS = 4_000_000
_CHARS = 500_000  # characters whose arrays are in memory at once
_ROWS = 8_192  # passages aligned at once
_COUNTERS = 1 << 20
_PASSAGES = 500_000  # passages looked at at once
_OUTSIDE = 0x110001  # what a passage is held against beyond its document
_BASE = 0x9E3779B97F4A7C15
_BITS = 22


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0: separates words, 1: letter or digit, 2: a word of its own."""
    out = np.strings.isalnum(np.arange(0x110000, dtype=np.uint32).view("<U1")).astype(np.uint8)
    out[0x3400:0xA000] = 2
    return out


def common_form(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' common forms one after the other.

    Returns code points (each text is led by q separators of its own kind, so no q-gram crosses texts),
    the text of each code point, the number of the word each code point belongs to (over all texts), and
    the position of each word's first code point.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.array([len(t) + 1 for t in low], dtype=np.int64)
    doc = np.repeat(np.arange(len(low)), lens)[: len(codes)]
    cls = _classes()[codes]
    prev = np.concatenate(([np.uint8(0)], cls[:-1])) if len(cls) else cls
    keep = cls > 0
    new = keep & ((prev == 0) | (cls == 2) | (prev == 2))
    kept, kdoc, knew = codes[keep], doc[keep], new[keep]
    word = np.cumsum(knew) - 1
    lead = (kdoc + 1) * Q
    pos = np.arange(len(kept)) + word + 1 + lead
    out = np.full((int(pos[-1]) + 2 if len(pos) else 1), 32, dtype=np.uint32)
    out[pos] = kept
    first = pos[knew]
    wdoc = kdoc[knew]
    # A separator no text contains stands before the first word of each text.
    if len(first):
        heads = np.concatenate(([True], wdoc[1:] != wdoc[:-1]))
        out[first[heads] - 1] = 0x110000
    at = np.zeros(len(out), dtype=np.int64)
    at[first] = 1
    words = np.cumsum(at) - 1
    return out, np.where(words >= 0, wdoc[np.maximum(words, 0)] if len(wdoc) else 0, -1), words, first


#: Passages that allow q-grams of these lengths at least are looked for together, with the shortest any of them allows.
CLASSES = (16, 11, 8, 6, 4, 2)


def gram_length(characters: int, edits: int) -> int:
    """The longest q-grams of which a passage of so many characters must keep one."""
    q = min(Q, characters // (edits + 1))
    if q < CLASSES[-1]:
        raise ValueError("the passages are too short for so many edits")
    return q


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q code points from each position on (fewer positions than code points by q - 1)."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    block, size = codes.astype(np.uint64) + np.uint64(1), 1
    h, done = None, 0
    while True:  # q is put together of powers of two
        if q & size:
            n = len(codes) - done - size + 1
            h = block[:n] if h is None else h[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + block[done : done + n]
            done += size
        if done == q:
            break
        block = block[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
        size *= 2
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(codes: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each word's characters."""
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    body = (codes != 32) & (codes < 0x110000) & (words >= 0)
    w, c = words[body], codes[body].astype(np.uint64) + np.uint64(1)
    at = (np.flatnonzero(body) - first[w]).astype(np.uint64)
    mixed = (c + at * np.uint64(0x632BE59BD9B4E019)) * np.uint64(_BASE)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    return np.add.reduceat(mixed, np.concatenate(([0], np.flatnonzero(np.diff(w)) + 1)))


class Items:
    """Passages of `words` words of the items, those of `least` to `below` characters, and the q-grams in them, sorted by
    hash. Built on the driver behind a check of size."""

    def __init__(self, ids: list[str], texts: list[str], words: int, edits: int, least: int = 0, below: int = 1 << 40):
        self.ids = ids
        codes, doc, word, first = common_form(texts)
        self.codes, self.doc, self.words, self.first = codes, doc, word, first
        self.word_hash = _word_hashes(codes, first, word)
        self.word_item = doc[first] if len(first) else np.empty(0, dtype=np.int64)
        n = max(0, len(first) - words + 1)
        body = np.flatnonzero((codes != 32) & (codes < 0x110000) & (word >= 0))
        last = np.zeros(len(first), dtype=np.int64)
        last[word[body]] = body  # the greatest position of each word comes last
        same = np.flatnonzero(self.word_item[words - 1 :] == self.word_item[:n]) if n else np.empty(0, dtype=np.int64)
        length = last[same + words - 1] + 1 - first[same]
        chosen = (length >= least) & (length < below)
        #: Where the passages begin, how long they are, and where each item's begin in the list.
        self.starts, self.lengths = first[same][chosen], length[chosen]
        self.of_item = np.searchsorted(self.word_item[same][chosen], np.arange(len(ids) + 1))
        self.q = gram_length(int(self.lengths.min()), edits) if len(self.lengths) else Q
        #: The fewest q-grams that a passage of each item must keep.
        self.fewest = np.full(len(ids), 1 << 40, dtype=np.int64)
        some = np.flatnonzero(np.diff(self.of_item))
        if len(some):
            shortest = np.minimum.reduceat(self.lengths, self.of_item[some])
            self.fewest[some] = np.maximum(1, shortest + 1 - self.q - self.q * edits)
        inside = np.zeros(len(codes) + 1, dtype=np.int64)  # the places whose q-gram lies in a passage
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.starts + self.lengths - self.q + 1, -1)
        h = gram_hashes(codes, self.q)
        pos = np.flatnonzero(_inner(codes, doc, self.q) & (np.cumsum(inside)[: len(h)] > 0))
        order = np.argsort(h[pos], kind="stable")
        self.hash = h[pos][order]
        self.pos = pos[order].astype(np.int64)
        self.item = doc[pos][order].astype(np.int64)
        self.seen = None
        if len(self.hash) > 1 << 16:  # a look into a table of bits spares most searches
            self.seen = np.zeros(1 << _BITS, dtype=bool)
            self.seen[self.hash >> np.uint64(64 - _BITS)] = True


def _inner(codes: np.ndarray, doc: np.ndarray, q: int = Q) -> np.ndarray:
    """The positions whose q-gram lies within one text."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    bad = np.cumsum(np.concatenate(([0], (codes >= 0x110000) | (doc < 0))))
    same = doc[:n] == doc[q - 1 :]
    return same & (bad[q:] == bad[:n])


def band_lists(diagonal: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bands of each diagonal: pairs (positions, band). A band starts every `edits` + 1 diagonals and
    covers 2 `edits` + 1, so any `edits` + 1 neighbouring diagonals lie in one band."""
    step, width = edits + 1, 2 * edits + 1
    top = np.floor_divide(diagonal, step)
    out = []
    for back in range(-(-width // step)):
        at = np.flatnonzero(diagonal < (top - back) * step + width)
        out.append((at, (top - back)[at]))
    return out


def longest_run(a: np.ndarray, b: np.ndarray, shift_low: int, shift_high: int) -> int:
    """Most consecutive equal words of `a` and `b` on the diagonals a - b from `shift_low` to `shift_high`."""
    best = 0
    for shift in range(max(shift_low, 1 - len(b)), min(shift_high, len(a) - 1) + 1):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        eq = a[lo:hi] == b[lo - shift : hi - shift]
        if not eq.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], eq, [False])).astype(np.int8)))
        best = max(best, int((edge[1::2] - edge[::2]).max()))
    return best


def banded_edits(
    codes: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray, width: int
) -> np.ndarray:
    """Least edits of each passage codes[at : at + n] against any stretch of `other` on `width` diagonals.

    The diagonals begin at `shift` (position in `other` minus position in `codes`); a stretch lies in other[low : high].
    One row of the alignment's table is computed for all passages at once.
    """
    out = np.empty(len(at), dtype=np.int64)
    for lo in range(0, len(at), _ROWS):
        part = slice(lo, lo + _ROWS)
        a, m = at[part], n[part]
        cost = np.zeros((len(a), width), dtype=np.int64)  # a stretch may begin anywhere in the band
        text = (a + shift[part])[:, None] + np.arange(width)
        result = cost.min(axis=1)
        for i in range(int(m.max())):
            pos = text + i
            inside = (pos >= low[part, None]) & (pos < high[part, None])
            seen = np.where(inside, other[np.clip(pos, 0, len(other) - 1)], _OUTSIDE)
            step = cost + (seen != codes[np.minimum(a + i, len(codes) - 1)][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            for b in range(1, width):
                step[:, b] = np.minimum(step[:, b], step[:, b - 1] + 1)
            cost = step
            ends = m == i + 1
            result[ends] = cost[ends].min(axis=1)
        out[part] = result
    return out


def item_classes(ids: list[str], texts: list[str], words: int, edits: int) -> list[Items]:
    """The items' passages by the length of the q-grams they allow."""
    out = []
    for below, least in zip((1 << 40, *CLASSES), (*CLASSES, 0)):
        items = Items(ids, texts, words, edits, least * (edits + 1), below * (edits + 1) if below <= Q else below)
        if len(items.lengths):
            out.append(items)
    return out


def _match(ids: list, texts: list[str], classes: list[Items], words: int, edits: int) -> list[tuple]:
    """(id, item, run, edits) of the texts that hold a passage of an item within the edit budget."""
    form = common_form(texts)
    return [row for items in classes for row in _match_class(ids, texts, form, items, edits, words)]


def _match_class(ids: list, texts: list[str], form: tuple, items: Items, edits: int, words: int) -> list[tuple]:
    codes, doc, word, first = form
    q = items.q
    h = gram_hashes(codes, q)
    if not len(h) or not len(items.hash):
        return []
    hit = _inner(codes, doc, q)
    hit = np.flatnonzero(hit if items.seen is None else hit & items.seen[h >> np.uint64(64 - _BITS)])
    lo = np.searchsorted(items.hash, h[hit], side="left")
    n = np.searchsorted(items.hash, h[hit], side="right") - lo
    hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
    if not len(hit):
        return []
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = np.repeat(hit, n)
    pair = doc[where] * len(items.ids) + items.item[at]
    # No passage can reach its bound where document and item share fewer q-grams in all than the shortest one's; pairs
    # that share a counter only raise it.
    fewest = items.fewest
    counter = pair % _COUNTERS
    enough = np.bincount(counter, minlength=_COUNTERS)[counter] >= fewest[items.item[at]]
    at, where, pair = at[enough], where[enough], pair[enough]
    if not len(at):
        return []
    diagonal = where - items.pos[at]
    lists = band_lists(diagonal, edits)
    low = min(int(b.min()) for _, b in lists if len(b))
    span = max(int(b.max()) for _, b in lists if len(b)) - low + 1
    hits = np.concatenate([x for x, _ in lists])
    keys = np.concatenate([pair[x] * span + (b - low) for x, b in lists])
    order = np.lexsort((items.pos[at[hits]], keys))
    keys, hits = keys[order], hits[order]
    place = items.pos[at[hits]]
    once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])))  # a q-gram of the item counts once a band
    keys, hits, place = keys[once], hits[once], place[once]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(begin, len(keys)))
    starts, lengths, of_item = items.starts, items.lengths, items.of_item
    enough = size >= fewest[(keys[begin] // span) % len(items.ids)]  # the same for bands
    chosen = np.repeat(enough, size)
    keys, hits, place, size = keys[chosen], hits[chosen], place[chosen], size[enough]
    if not len(keys):
        return []
    begin = np.cumsum(size) - size
    region_item = (keys[begin] // span) % len(items.ids)
    count = of_item[region_item + 1] - of_item[region_item]
    wide = np.int64(len(items.codes) + 1)
    ranked = np.repeat(np.arange(len(begin)), size) * wide + place
    regions, chosen_passages = [], []
    for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(np.cumsum(count) // _PASSAGES)) + 1):
        # Every passage of the regions' items: how many of its q-grams the band holds.
        n = count[part]
        region = np.repeat(part, n)
        passage = np.repeat(of_item[region_item[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first_gram = region * wide + starts[passage]
        shared = np.searchsorted(ranked, first_gram + lengths[passage] - q, side="right") - np.searchsorted(ranked, first_gram)
        ok = shared >= np.maximum(1, lengths[passage] + 1 - q - q * edits)
        regions.append(region[ok])
        chosen_passages.append(passage[ok])
    region, passage = np.concatenate(regions), np.concatenate(chosen_passages)
    if not len(region):
        return []
    inside = np.searchsorted(doc, np.arange(len(texts) + 1))  # `doc` is in order, but for what leads the first text
    of_doc = keys[begin][region] // span // len(items.ids)
    shift = (keys[begin][region] % span + low) * (edits + 1)
    need = banded_edits(items.codes, starts[passage], lengths[passage], codes, shift, inside[of_doc], inside[of_doc + 1], 2 * edits + 1)
    good = need <= edits
    least: dict[tuple, int] = {}
    pairs = of_doc[good] * len(items.ids) + region_item[region[good]]
    for x, e in zip(pairs.tolist(), need[good].tolist()):
        least[x] = min(e, least.get(x, e))
    if not least:
        return []
    # The words that the pairs' q-grams touch tell which diagonals of words to look for equal runs on.
    mine, wdoc = _word_hashes(codes, first, word), doc[first]
    hits = hits[np.isin(pair[hits], list(least))]
    wordwise = word[where[hits]] - items.words[items.pos[at[hits]]]
    step = np.int64(4 * len(codes) + 4 * len(items.doc))
    runs: dict[int, int] = {}
    for r in np.unique(pair[hits] * step + wordwise + len(items.doc)).tolist():
        x, s = divmod(r, int(step))
        (d, i), s = divmod(x, len(items.ids)), s - len(items.doc)
        a = slice(*np.searchsorted(wdoc, [d, d + 1]))
        z = slice(*np.searchsorted(items.word_item, [i, i + 1]))
        local = s - (a.start - z.start)
        runs[x] = max(runs.get(x, 0), longest_run(mine[a], items.word_hash[z], local, local))
    return [(ids[x // len(items.ids)], items.ids[x % len(items.ids)], runs.get(x, 0), e) for x, e in least.items()]


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
    keys, lo, size = pdf["key"].tolist(), 0, 0
    for hi in range(1, len(texts) + 1):
        size += len(texts[hi - 1])
        if size >= _CHARS or hi == len(texts):
            yield keys[lo:hi], texts[lo:hi]
            lo, size = hi, 0


def _grams(df: DataFrame, names: dict[str, str], q: int) -> DataFrame:
    """The columns `names` (with types), gram, pos: every q-gram of the common form of `text`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row = 0
            for keys, texts in _batches(pdf.rename(columns={next(iter(names)): "key"})):
                codes, doc, _, _ = common_form(texts)
                pos = np.flatnonzero(_inner(codes, doc, q))
                start = np.searchsorted(doc, np.arange(len(texts)), side="left")
                d = doc[pos]
                kept = {c: pd.Series(pdf[c].iloc[row : row + len(texts)].to_numpy(), dtype=object).iloc[d].to_numpy() for c in names}
                yield pd.DataFrame({**kept, "gram": gram_hashes(codes, q)[pos].astype(np.int64), "pos": pos - start[d]})
                row += len(texts)

    return df.select(*names, "text").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in names.items()) + ", gram bigint, pos bigint")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "id",
    item_text: str = "text",
    words: int = 12,
    edits: int = 0,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """(document, item, run, edits): documents that hold `words` consecutive words of an item with at most `edits` edits.

    `edits` is the least number over all passages, `run` the longest run of equal words. A passage that stands there
    inside longer words needs no edit, but is no run of `words` words.
    """
    spark = docs.sparkSession
    key_type = docs.schema[doc_key].dataType.simpleString()
    corpus = docs.select(docs[doc_key].alias("key"), docs[doc_text].cast("string").alias("text"))
    held = items.select(items[item_key].cast("string").alias("key"), items[item_text].cast("string").alias("text")).where(
        F.col("text").isNotNull() & F.col("key").isNotNull()
    )
    columns = ["key", "item", "run", "edits"]
    out_schema = f"key {key_type}, item string, run int, edits int"
    chars = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if 2 * chars <= broadcast_grams:
        rows = held.orderBy("key", "text").collect()
        shared = spark.sparkContext.broadcast(item_classes([r[0] for r in rows], [r[1] for r in rows], words, edits))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for keys, texts in _batches(pdf):
                    yield pd.DataFrame(_match(keys, texts, shared.value, words, edits), columns=columns)

        found = corpus.mapInPandas(run, out_schema)
    else:
        step, width = edits + 1, 2 * edits + 1
        # Keys can be null or repeated: a document is its key and the hash of its text.
        corpus = corpus.where(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))

        def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for keys, texts in _batches(pdf):
                    one = Items(keys, texts, words, edits)
                    ok = np.flatnonzero(np.diff(one.of_item)).tolist()
                    q = [gram_length(int(one.lengths[one.of_item[i] : one.of_item[i + 1]].min()), edits) for i in ok]
                    yield pd.DataFrame({"key": [keys[i] for i in ok], "text": [texts[i] for i in ok], "q": q})

        held = cut(held.mapInPandas(sized, "key string, text string, q bigint"))
        kept = None
        for q in [r[0] for r in held.select("q").distinct().orderBy("q").collect()]:  # at most Q - 1
            least = max(1, max(2 * words - 1, q * (edits + 1)) + 1 - q - q * edits)  # no passage of these is shorter
            grams = _grams(corpus, {"key": key_type, "th": "bigint"}, q).join(
                _grams(held.where(F.col("q") == q), {"key": "string"}, q).select(F.col("key").alias("item"), "gram", F.col("pos").alias("item_pos")),
                "gram",
            )
            top = F.floor((F.col("pos") - F.col("item_pos")) / step)
            inside = [F.when(F.col("pos") - F.col("item_pos") < (top - k) * step + width, top - k) for k in range(-(-width // step))]
            one = (
                grams.select("key", "th", "item", F.explode(F.array_compact(F.array(*inside))).alias("band"))
                .groupBy("key", "th", "item", "band")
                .agg(F.count("*").alias("n"))
                .where(F.col("n") >= least)
                .select(F.col("key").alias("k"), F.col("th").alias("h"), "item")
                .distinct()
            )
            kept = one if kept is None else kept.unionByName(one)
        if kept is None:
            return spark.createDataFrame([], f"`{doc_key}` {key_type}, seed_id string, run int, edits int")
        pairs = kept.join(held.select(F.col("key").alias("item"), F.col("text").alias("item_text")).distinct(), "item")
        pairs = pairs.join(corpus, (F.col("h") == F.col("th")) & F.col("k").eqNullSafe(F.col("key")))

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for (i, it), part in pdf.groupby(["item", "item_text"], sort=False):
                    one = item_classes([i], [it], words, edits)
                    for keys, texts in _batches(part):
                        out += _match(keys, texts, one, words, edits)
                yield pd.DataFrame(out, columns=columns)

        found = pairs.select("key", "item", "text", "item_text").mapInPandas(verify, out_schema)
    return found.groupBy(F.col("key").alias(doc_key), F.col("item").alias("seed_id")).agg(
        F.max("run").alias("run"), F.min("edits").alias("edits")
    )
