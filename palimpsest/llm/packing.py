"""Packing texts into containers of a fixed number of tokens.

Items are the texts, and for texts above the capacity their runs of `capacity` tokens; no other text is
split. Items are dealt to blocks of bounded size by a hash of their key, each block is packed from two starts
(best fit decreasing; bin by bin with the pair that leaves least room), both are improved by local search, the
better one is kept, and the bins a block leaves underfull go into a second round
with those of other blocks. Only keys and sizes are shuffled; nothing is collected.

Local search: bins with room are taken as targets, fullest first, and everything in bins less full than a
target is on offer to it. Of all moves of one document, exchanges of one for one and of two (of one bin) for
one, the one that fills the target most is made, until none fills it further. So every step moves tokens to a
bin at least as full as the one they come from: the sum of squared fills grows, room gathers in few bins, whose
documents become small, until they move away altogether and the bins are empty. Passes are repeated until one
changes nothing. Offers are looked up by size, in a set of bits per kind of offer, not tried one by one.

Defined results: null and empty texts are items of no tokens and are placed like others; a text of
exactly the capacity fills a container; repeated keys are separate items, told apart by `copy_no`; extra
columns are ignored; an empty table gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import VOCABULARY, encoding
from palimpsest.sources.tables import cut

#: Items that one task packs at once.
BLOCK_ITEMS = 4_000
#: A bin at least this full is final after the first round.
FULL = 0.995


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions, best fit decreasing; bins with equal room are kept in stacks by room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, dtype=bool)
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        hit = int(np.argmax(rooms[s:])) + s
        if rooms[hit] and hit >= s:
            b = by_room[hit].pop()
            if not by_room[hit]:
                rooms[hit] = False
            bins[b].append(i)
            left = hit - s
        else:
            b = len(bins)
            bins.append([i])
            left = capacity - s
        by_room[left].append(b)
        rooms[left] = True
    return bins


def best_pairs(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions, one bin after the other: the largest item left, then the largest that fits, while
    more than two can follow, then the one or two that leave least room."""
    left: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        left.setdefault(int(sizes[i]), []).append(i)
    held = np.array(sorted(left), dtype=np.int64)
    many = np.array([len(left[s]) for s in held.tolist()], dtype=np.int64)
    bins: list[list[int]] = []
    while len(held):
        bins.append([])
        room = capacity
        take = [len(held) - 1]
        while take:
            for k in take:
                bins[-1].append(left[int(held[k])].pop())
                room -= int(held[k])
                many[k] -= 1
            keep = many > 0
            if not keep.all():
                held, many = held[keep], many[keep]
            n = int(np.searchsorted(held, room, side="right"))  # the sizes that fit
            take = []
            if n:
                fit = held[:n]
                other = np.searchsorted(held, room - fit, side="right") - 1
                other = np.where((other == np.arange(n)) & (many[:n] < 2), other - 1, other)
                pair = np.where(other >= 0, fit + held[np.maximum(other, 0)], 0)
                k = int(np.argmax(pair))
                if pair[k] > 0 and room - pair[k] >= held[0] and fit[-1] * 2 < room:
                    take = [n - 1]  # there is room for more than two
                else:
                    take = sorted({k, int(other[k])}) if pair[k] > fit[-1] and k != other[k] else [k, k] if pair[k] > fit[-1] else [n - 1]
    return bins


class _Offers:
    """What bins have to give, by size: the places (bin, documents) of every size, and a bit for each size held."""

    def __init__(self):
        self.places: dict[int, set] = {}
        self.bits = 0

    def add(self, size: int, place: tuple) -> None:
        held = self.places.setdefault(size, set())
        if not held:
            self.bits |= 1 << size
        held.add(place)

    def remove(self, size: int, place: tuple) -> None:
        held = self.places[size]
        held.discard(place)
        if not held:
            self.bits &= ~(1 << size)

    def most(self, size: int) -> int:
        """The greatest size on offer up to `size`; 0 if there is none."""
        return max(0, (self.bits & ((1 << (size + 1)) - 1)).bit_length() - 1)


class _Search:
    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.bins = [list(b) for b in bins]
        self.size = sizes.tolist()
        self.capacity = capacity
        self.fill = [sum(self.size[i] for i in b) for b in self.bins]
        self.one, self.two = _Offers(), _Offers()

    def _twos(self, b: int):
        """The pairs of a bin, one of each two sizes."""
        first = {}
        for i in self.bins[b]:
            first.setdefault(self.size[i], []).append(i)
        held = sorted(first)
        for k, s in enumerate(held):
            if s and len(first[s]) > 1:
                yield 2 * s, (b, first[s][0], first[s][1])
            for t in held[k + 1 :]:
                if s and s + t <= 2 * self.capacity:
                    yield s + t, (b, first[s][0], first[t][0])

    def offer(self, b: int, pairs: bool) -> None:
        for i in self.bins[b]:
            if self.size[i]:
                self.one.add(self.size[i], (b, i))
        if pairs:
            for s, place in self._twos(b):
                self.two.add(s, place)

    def withdraw(self, b: int, pairs: bool) -> None:
        for i in self.bins[b]:
            if self.size[i]:
                self.one.remove(self.size[i], (b, i))
        if pairs:
            for s, place in self._twos(b):
                self.two.remove(s, place)

    def best(self, t: int, pairs: bool) -> tuple[int, tuple, list[int]]:
        """The exchange that fills bin `t` most: gain, what comes in (bin, documents), what goes out."""
        gap = self.capacity - self.fill[t]
        top: tuple = (0, None, 0, [])  # gain, offers, size in, out
        s = self.one.most(gap)
        if s:
            top = (s, self.one, s, [])
        own = {self.size[j]: j for j in self.bins[t]}
        for offers in (self.one, self.two) if pairs else (self.one,):
            for out, j in own.items():
                if top[0] == gap:
                    break
                s = offers.most(out + gap)
                if s - out > top[0]:
                    top = (s - out, offers, s, [j])
        gain, offers, s, out = top
        if not gain:
            return 0, (), []
        # Of equal offers, the emptiest bin's.
        return gain, min(offers.places[s], key=lambda p: (self.fill[p[0]], p)), out

    def round(self, pairs: bool) -> bool:
        """One pass over the bins with room, fullest first; whether anything changed."""
        open_ = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
        self.one, self.two = _Offers(), _Offers()
        for b in open_:
            self.offer(b, pairs)
        changed = False
        for t in open_:
            self.withdraw(t, pairs)
            while self.fill[t] < self.capacity:
                gain, come, out = self.best(t, pairs)
                if not gain:
                    break
                d, items = come[0], list(come[1:])
                self.withdraw(d, pairs)
                for i in items:
                    self.bins[d].remove(i)
                for j in out:
                    self.bins[t].remove(j)
                self.bins[t] += items
                self.bins[d] += out
                self.fill[t] += gain
                self.fill[d] -= gain
                self.offer(d, pairs)
                changed = True
        return changed


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over underfull bins until no exchange fills one further."""
    search = _Search(bins, sizes, capacity)
    while search.round(False) or search.round(True):
        pass
    full = [b for k, b in enumerate(search.bins) if b and search.fill[k]]
    rest = [i for k, b in enumerate(search.bins) if not search.fill[k] for i in b]  # items of no tokens
    if rest:
        if full:
            full[-1] += rest
        else:
            full.append(rest)
    return full


def packed(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The better of the searches from either start: fewer bins, then the greater sum of squared fills."""
    both = [improve(start(sizes, capacity), sizes, capacity) for start in (best_pairs, best_fit)]
    return min(both, key=lambda bins: (len(bins), -sum(int(sizes[b].sum()) ** 2 for b in bins)))


def token_items(
    docs: DataFrame, text: str, key: str, capacity: int, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The items: key, copy_no, part_no, token_start, tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "n": n})

    key_type = docs.schema[key].dataType.simpleString()
    sized = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInPandas(
        count, f"key {key_type}, n bigint"
    )
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))
    return sized.withColumn("copy_no", F.monotonically_increasing_id()).select(
        "key",
        "copy_no",
        F.explode(parts).alias("part_no"),
        "n",
    ).select(
        "key",
        "copy_no",
        "part_no",
        (F.col("part_no") * capacity).cast("bigint").alias("token_start"),
        F.least(F.lit(capacity), F.col("n") - F.col("part_no") * capacity).cast("bigint").alias("tokens"),
    )


def _round(items: DataFrame, capacity: int, block_items: int, label: str, key_type: str) -> DataFrame:
    """Packs `items` (with `block`) and adds bin_id and bin_tokens."""
    schema = f"key {key_type}, copy_no bigint, part_no int, token_start bigint, tokens bigint, bin_id string, bin_tokens bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["tokens", "key", "copy_no", "part_no"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["tokens"].to_numpy(dtype=np.int64)
        bins = packed(sizes, capacity)
        where = np.empty(len(sizes), dtype=np.int64)
        total = np.empty(len(bins), dtype=np.int64)
        for k, b in enumerate(bins):
            where[b] = k
            total[k] = sizes[b].sum()
        return pdf.drop(columns="block").assign(
            bin_id=[f"{label}{block:08d}-{k:06d}" for k in where], bin_tokens=total[where]
        )

    return items.groupBy("block").applyInPandas(run, schema)


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = 2048,
    vocabulary: str = VOCABULARY,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Containers of at most `capacity` tokens.

    Returns key, copy_no, part_no, token_start, tokens, container, container_tokens; one row per item.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    key_type = docs.schema[key].dataType.simpleString()
    items = cut(token_items(docs, text, key, capacity, vocabulary))
    n = items.count()
    blocks = max(1, -(-n // block_items))
    first = cut(_round(
        items.withColumn("block", F.pmod(F.xxhash64("copy_no", "part_no"), F.lit(blocks))), capacity, block_items, "a", key_type
    ))
    done = F.col("bin_tokens") >= int(FULL * capacity)
    rest = first.where(~done).drop("bin_id", "bin_tokens")
    second = _round(
        rest.withColumn("block", F.pmod(F.xxhash64("part_no", "copy_no"), F.lit(max(1, -(-rest.count() // block_items))))),
        capacity, block_items, "b", key_type,
    )
    return first.where(done).unionByName(second).select(
        F.col("key").alias(key),
        "copy_no",
        "part_no",
        "token_start",
        "tokens",
        F.col("bin_id").alias("container"),
        F.col("bin_tokens").alias("container_tokens"),
    )
