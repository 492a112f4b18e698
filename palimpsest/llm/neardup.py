"""Near-duplicate records: pairs of texts whose sets of character 5-grams have a Jaccard of `threshold` or more.

The universe of 5-grams is partitioned by hashes into segments, with their number set by size band.

In the exact bands (`EXACT`, a pair's smaller record below 130 5-grams) the pigeonhole holds as it stands: a pair at
the threshold differs in at most H 5-grams, so if segment i may differ in v_i of them and the v_i + 1 sum up to more
than H, some segment keeps within its v_i. A segment is left out (v = -1), compared whole (v = 0) or with the
neighbourhoods of one deletion (v = 1): a record indexes the segment and every one of its subsets with one 5-gram
left out, and two records meet where at least one of them is whole. Which segments get what is a question of cost:
there are a few more segments than needed, the candidates of each under either form are counted from the index, and
the allocation with the fewest in all is chosen. No pair is missed.

In the larger bands (`BANDS`) that form does not end: measured in the README, segments of two to five 5-grams, which
unrelated records of one language share as well, give tens of thousands of candidates a record and up to 670 index
entries. There a record indexes two subsets of each larger segment, its `subset` least and greatest 5-grams by the
same hash: two records agree in one if the union's least (greatest) 5-grams there are shared, so near-duplicates
agree in many and unrelated records in hardly any. Records of two common subsets are candidates. A pair at the very
threshold is missed with a probability of some 5e-4, and one at 0.75 of some 2e-5 (README).

Every candidate is verified exactly on whole texts.

As Spark jobs: equal normalised texts collapse to one, found by their hash with map-side combine; index entries are hashed
in Arrow batches and shuffled by hash, not as rows but as blocks of packed numbers (`_blocks`), which a task sorts and
counts in arrays (`_Share`): single entries fall away, and the rest is
joined. Buckets above `bucket_rows` are not joined in one task: their rows are cut into blocks, pairs of
blocks are compared by a 256-bit sketch, and only pairs that can reach the threshold are emitted (a pair at the very
threshold is held back with a probability of 1e-9).

Defined results: null texts and texts of fewer than 5 characters after normalising pair with nothing, not
even with each other; repeated rows pair like others; rows with a null key are left out; an empty table
gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import cut

GRAM = 5
#: (least size of a pair's smaller record, segments, subset, partitions): the bands above the short texts.
#: Each band has some twice as many 5-grams a segment as its subset holds, and the universe is partitioned
#: anew until there are entries enough to find a pair at the threshold.
BANDS = ((130, 15, 5, 2), (300, 20, 6, 2))
#: Least sizes of a pair's smaller record in the exact bands; the last one ends below the first of BANDS.
EXACT = (1, 4, 8, 12, 18, 27, 40, 60, 90)
#: Rows of a bucket that are joined directly.
BUCKET = 1_000
#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000
_SKETCH_LONGS = 4
_CHARS = 1_500_000
_HELD = 1_000_000  # characters of the texts whose 5-grams are kept at once
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_TAG = 53  # where the tag of an exact band's segment begins in an index entry
_TAG_BITS = 10  # of such a tag
_SPLIT = 6  # bits of a hash by which entries are shared out
_SHARED = 1_500_000  # entries a share is meant to hold
_BLOCK = 512  # entries of a shuffled block
_SENT = 2_000_000  # entries made into blocks at once
_FULL = 8_000_000  # entries of a share beyond which its crowded buckets are put out before its end
_BITS = 44  # of a 5-gram's hash, below the record's place in its batch


def normal_form(text: Column) -> Column:
    """Lower case, other characters than letters and digits made one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64(_MIX[k % 5])
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MIX[(k + 1) % 5])
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 5-grams of each text as hashes of _BITS bits in order, and where each text's begin."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    if len(codes) < GRAM:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    h = np.zeros(len(codes) - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(_MIX[0]) + codes[i : len(codes) - GRAM + 1 + i] + np.uint64(1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lens)
    inside = doc[: len(h)] == doc[GRAM - 1 :]
    key = (doc[: len(h)][inside].astype(np.uint64) << np.uint64(_BITS)) | (_mix(h[inside], 0) >> np.uint64(64 - _BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    begin = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(_BITS))
    return key & np.uint64((1 << _BITS) - 1), begin


def signatures(grams: np.ndarray, begin: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(record, signature): the segment subsets of every record, in the larger bands it can pair in.

    The lowest bit of a signature tells the exact bands, in which one agreement makes a candidate.
    """
    n = np.diff(begin)
    rec = np.repeat(np.arange(len(n)), n)
    recs, sigs = [], []
    for b, (least, segments, subset, partitions) in enumerate(BANDS):
        below = BANDS[b + 1][0] / threshold if b + 1 < len(BANDS) else np.inf
        own = (n >= least) & (n < below)
        mine = np.flatnonzero(own[rec])
        if not len(mine):
            continue
        for part in range(partitions):
            key = (rec[mine].astype(np.uint64) << np.uint64(_BITS)) | (_mix(grams[mine], part) >> np.uint64(64 - _BITS))
            key.sort()
            who = (key >> np.uint64(_BITS)).astype(np.int64)
            gram = key & np.uint64((1 << _BITS) - 1)
            place = who.astype(np.uint64) * np.uint64(segments) + ((gram * np.uint64(segments)) >> np.uint64(_BITS))
            new = np.concatenate(([True], place[1:] != place[:-1]))
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            order = np.arange(len(key)) - starts[run]
            size = np.diff(np.append(starts, len(key)))
            full = size >= subset  # smaller segments tell too little
            code = _mix(gram + np.uint64(1 + b), 1)
            for end in (0, 1):  # the least 5-grams of a segment, and the greatest
                picked = order < subset if end == 0 else order >= size[run] - subset
                total = np.add.reduceat(np.where(picked, code, np.uint64(0)), starts)[full]
                at = starts[full]
                label = (place[at] % np.uint64(segments)) * np.uint64(_MIX[3]) + np.uint64(16 * b + 2 * part + end)
                recs.append(who[at])
                sigs.append(_mix(total + label, 2) & ~np.uint64(1))
    if not recs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(recs), np.concatenate(sigs)


def exact_bands(threshold: float) -> list[tuple[int, int, int, int]]:
    """Of each exact band: the least size of a pair's smaller record, the greatest of its larger one, the bound H of the
    difference, the number of segments (an eighth more than one-deletion neighbourhoods of all would need)."""
    out = []
    for lo, hi in zip(EXACT, (*EXACT[1:], BANDS[0][0])):
        top = int((hi - 1) / threshold + 1e-9)
        bound = int((1 - threshold) / (1 + threshold) * (hi - 1 + top) + 1e-9)
        need = bound // 2 + 1
        out.append((lo, top, bound, need + max(1, need // 8)))
    return out


def exact_entries(grams: np.ndarray, begin: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(record, signature, kind, tag): the segments of the exact bands and their subsets of one deletion.

    `kind` is 1 for a whole segment, and 2 more for a record that can be a pair's smaller one in the band: two records
    meet if at least one segment is whole and at least one record small. `tag` is 64 times the band's place plus the
    segment's, both from 1.
    """
    bands = exact_bands(threshold)
    few = np.flatnonzero(np.diff(begin) <= bands[-1][1])  # most records are larger than any of these bands
    n = np.diff(begin)[few]
    grams = grams[np.repeat(begin[few] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    rec = np.repeat(np.arange(len(n)), n)
    recs, sigs, kinds, tags = [], [], [], []
    for k, (lo, top, _, segments) in enumerate(bands):
        below = (*EXACT[1:], BANDS[0][0])[k]
        own = np.flatnonzero((n >= lo) & (n <= top))
        if not len(own):
            continue
        place = np.full(len(n), -1)
        place[own] = np.arange(len(own))
        mine = np.flatnonzero(place[rec] >= 0)
        gram = _mix(grams[mine], 2) >> np.uint64(64 - _BITS)
        seg = ((gram * np.uint64(segments)) >> np.uint64(_BITS)).astype(np.int64)
        at = place[rec[mine]] * segments + seg
        code = _mix(grams[mine] + np.uint64(101 + k), 1)
        total = np.zeros(len(own) * segments, dtype=np.uint64)
        np.add.at(total, at, code)
        label = np.arange(1, segments + 1, dtype=np.uint64) * np.uint64(_MIX[3]) + np.uint64(7919 * (k + 1))
        tag = 64 * (k + 1) + np.arange(1, segments + 1)
        recs += [np.repeat(few[own], segments), few[rec[mine]]]
        sigs += [_mix(total + np.tile(label, len(own)), 2) | np.uint64(1), _mix(total[at] - code + label[seg], 2) | np.uint64(1)]
        small = np.where(n[own] < below, 2, 0)
        kinds += [np.repeat(small + 1, segments), small[place[rec[mine]]]]
        tags += [np.tile(tag, len(own)), tag[seg]]
    if not recs:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    return np.concatenate(recs), np.concatenate(sigs), np.concatenate(kinds), np.concatenate(tags)


def allocation(costs: list[tuple[int, float, float]], threshold: float) -> dict[int, int]:
    """What each segment of the exact bands is compared by, so that the candidates are fewest: 0 whole, 1 with one
    deletion; segments left out are missing. `costs`: tag, candidates whole, candidates with one deletion."""
    known = {t: (w, d) for t, w, d in costs}
    out = {}
    for k, (_, _, bound, segments) in enumerate(exact_bands(threshold)):
        # best[g]: the least cost of the segments so far that gain g, where v + 1 is a segment's gain.
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for i in range(1, segments + 1):
            tag = 64 * (k + 1) + i
            whole, deleted = known.get(tag, (0.0, 0.0))
            step: dict[int, tuple[float, tuple]] = {}
            for gain, (cost, chosen) in best.items():
                for v, more in ((-1, 0.0), (0, whole), (1, deleted)):
                    g = min(bound + 1, gain + v + 1)
                    new = (cost + more, (*chosen, v))
                    if g not in step or new[0] < step[g][0]:
                        step[g] = new
            best = step
        out |= {64 * (k + 1) + i: v for i, v in enumerate(best[bound + 1][1], 1) if v >= 0}
    return out


def sketches(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One bit of the least 5-gram of each of 256 hashed orders, as 4 longs a record."""
    n = np.diff(begin)
    out = np.zeros((len(n), _SKETCH_LONGS), dtype=np.uint64)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out.view(np.int64)
    for k in range(64 * _SKETCH_LONGS):
        h = _mix(grams + np.uint64(k * 0x1F123BB5 + 11), k)
        low = np.minimum.reduceat(h, begin[full])
        out[full, k // 64] |= ((low >> np.uint64(17)) & np.uint64(1)) << np.uint64(k % 64)
    return out.view(np.int64)


def _small(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """The ids as a broadcast side if they are few, which is counted; else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= bound else ids


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = pdf["text"].str.len().cumsum() // _CHARS
    for _, part in pdf.groupby(size.to_numpy(), sort=True):
        yield part


def _blocks(sig: np.ndarray, entry: np.ndarray, bits: int, split: int) -> pd.DataFrame:
    """Index entries as blocks of the same share: share, base, sigs, entries.

    A hash holds `bits` bits and a tag from _TAG on; the `split` bits above the lowest tell the share and are not
    repeated. Entries are differences from the block's least.
    """
    full = (sig & np.uint64((1 << bits) - 1)) | ((sig >> np.uint64(_TAG)) << np.uint64(bits))
    share = ((full >> np.uint64(1)) & np.uint64((1 << split) - 1)).astype(np.uint16)
    order = np.argsort(share, kind="stable")
    share, entry = share[order], entry[order]
    short = (((full >> np.uint64(split + 1)) << np.uint64(1)) | (full & np.uint64(1)))[order]
    begin = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1]))) if len(share) else np.empty(0, dtype=np.int64)
    ends = np.append(begin[1:], len(share))
    starts = np.concatenate([np.arange(b, e, _BLOCK) for b, e in zip(begin, ends)] or [begin])
    ends = np.append(starts[1:], len(share))
    base = np.minimum.reduceat(entry, starts) if len(starts) else np.empty(0, dtype=np.int64)
    more = entry - np.repeat(base, ends - starts)
    wide = max(1, (int(more.max()).bit_length() + 7) // 8) if len(more) else 1
    width = _width(bits, split)
    sigs = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    its = more.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    at = list(zip(starts.tolist(), ends.tolist()))
    return pd.DataFrame(
        {
            "share": share[starts].astype(np.int32),
            "base": base,
            "sigs": pd.Series([sigs[lo * width : hi * width] for lo, hi in at], dtype=object),
            "entries": pd.Series([its[lo * wide : hi * wide] for lo, hi in at], dtype=object),
        }
    )


def _width(bits: int, split: int) -> int:
    return -(-(bits + _TAG_BITS - split) // 8)


def _whole_numbers(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


class _Share:
    """The entries of one share, from its blocks: those that fall together, as (sig, entry, n, later) in Arrow batches.

    `n` is the size of the bucket and `later` its entries behind this one; in crowded buckets, of more than
    `bucket_rows`, n is -1 and `later` nothing. Crowded buckets are put out as soon as a share is full, so their size
    does not matter; other entries are spread evenly by their hashes.
    """

    def __init__(self, share: int, bits: int, split: int, bucket_rows: int):
        self.share, self.bits, self.split, self.rows = share, bits, split, bucket_rows
        self.blocks: list = []
        self.held, self.full = 0, _FULL
        self.hot = np.empty(0, dtype=np.uint64)
        self.sig, self.entry = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def add(self, base: list[int], sigs: list[bytes], entries: list[bytes]) -> Iterator:
        width = _width(self.bits, self.split)
        self.blocks += zip(base, sigs, entries)
        self.held += sum(map(len, sigs)) // width
        if self.held > self.full:
            self._load()
            order = np.argsort(self.sig)
            sig = self.sig[order]
            begin, size = _runs(sig)
            crowded = np.repeat(size > self.rows, size)
            self.hot = np.union1d(self.hot, sig[begin[size > self.rows]])
            yield from self._crowded(sig[crowded], self.entry[order[crowded]])
            self.sig, self.entry = sig[~crowded], self.entry[order[~crowded]]
            self.held = len(self.sig)
            self.full = max(_FULL, 2 * self.held)

    def _load(self) -> None:
        """Takes the blocks in, less those entries whose bucket is known to be crowded, which stay apart."""
        width = _width(self.bits, self.split)
        sigs, entries = [self.sig], [self.entry]
        wides: dict[int, list] = {}
        for b in self.blocks:
            wides.setdefault(len(b[2]) * width // len(b[1]), []).append(b)
        for wide, own in wides.items():
            base = np.repeat(np.array([b[0] for b in own], dtype=np.int64), [len(b[1]) // width for b in own])
            sigs.append(_whole_numbers(b"".join([b[1] for b in own]), width))
            entries.append(base + _whole_numbers(b"".join([b[2] for b in own]), wide).astype(np.int64))
        self.blocks = []
        self.sig, self.entry = np.concatenate(sigs), np.concatenate(entries)

    def _out(self, sig: np.ndarray, entry: np.ndarray, n: np.ndarray, later):
        import pyarrow as pa

        split = np.uint64(self.split + 1)
        full = ((sig >> np.uint64(1)) << split) | np.uint64(self.share << 1) | (sig & np.uint64(1))
        tag = full >> np.uint64(self.bits)
        whole = (full & np.uint64((1 << self.bits) - 1)) | (tag << np.uint64(_TAG))
        return pa.RecordBatch.from_arrays(
            [pa.array(whole.view(np.int64)), pa.array(entry), pa.array(n), later], names=["sig", "entry", "n", "later"]
        )

    def _crowded(self, sig: np.ndarray, entry: np.ndarray) -> Iterator:
        import pyarrow as pa

        for lo in range(0, len(sig), 500_000):
            own = slice(lo, lo + 500_000)
            n = len(sig[own])
            yield self._out(sig[own], entry[own], np.full(n, -1), pa.nulls(n, pa.list_(pa.int64())))

    def close(self) -> Iterator:
        import pyarrow as pa

        self._load()
        sig, entry = self.sig, self.entry
        if len(sig) <= 1 << 24:
            # Those alike in 40 bits, from one sort of plain numbers; few of all.
            key = (sig << np.uint64(24)) | np.arange(len(sig), dtype=np.uint64)
            key.sort()
            same = (key[1:] ^ key[:-1]) >> np.uint64(24) == 0
            some = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(sig) else np.empty(0, dtype=bool)
            at = (key[some] & np.uint64((1 << 24) - 1)).astype(np.int64)
            if len(self.hot):
                at = np.union1d(at, np.flatnonzero(np.isin(sig, self.hot)))
            sig, entry = sig[at], entry[at]
        order = np.lexsort((entry, sig))
        sig, entry = sig[order], entry[order]
        begin, size = _runs(sig)
        hot = np.repeat((size > self.rows) | np.isin(sig[begin], self.hot), size)
        yield from self._crowded(sig[hot], entry[hot])
        n = np.repeat(size, size)
        after = np.repeat(begin + size, size) - np.arange(len(sig)) - 1
        tagged = (sig >> np.uint64(self.bits - self.split)) > 0
        rows = np.flatnonzero((n > 1) & ~hot & ((after > 0) | tagged))
        # Batches of a bounded number of later entries.
        cut_at = np.cumsum(after[rows] + 1) // 1_000_000
        for own in np.split(rows, np.flatnonzero(cut_at[1:] != cut_at[:-1]) + 1) if len(rows) else []:
            many = after[own]
            offsets = np.concatenate(([0], np.cumsum(many)))
            flat = entry[np.repeat(own + 1 - offsets[:-1], many) + np.arange(offsets[-1])]
            later = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield self._out(sig[own], entry[own], n[own], later)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and its length."""
    begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, dtype=np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def similar(texts: DataFrame, threshold: float = 0.7, bucket_rows: int = BUCKET, bits: int = _TAG, split: int = _SPLIT) -> DataFrame:
    """Pairs of distinct texts: field, a, b (ids, a < b), jaccard. `texts`: field, id, text (distinct, normalised).

    `bits` is the width of an index entry; they are shared out to 2^`split` parts. Fields never mix: the hash of the field is part of every signature.
    """
    recs = texts.where(F.length("text") >= GRAM)
    mask = np.uint64((1 << bits) - 1)

    def entries_of(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        grams, begin = gram_sets(part["text"].tolist())
        rec, sig = signatures(grams, begin, threshold)
        exact, its, kind, tag = exact_entries(grams, begin, threshold)
        # The tag lies above the hash's bits, so it takes no column of its own.
        its = (its & mask) | (tag.astype(np.uint64) << np.uint64(_TAG))
        salt = part["salt"].to_numpy().astype(np.uint64) & mask & ~np.uint64(1)
        number = part["id"].to_numpy() * 4
        sig = np.concatenate(((sig & mask) ^ salt[rec], its ^ salt[exact]))
        return sig, np.concatenate((number[rec] + 3, number[exact] + kind))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, many = [], 0
        for pdf in batches:
            for part in _chunks(pdf):
                held.append(entries_of(part))
                many += len(held[-1][0])
                if many > _SENT:
                    yield _blocks(*(np.concatenate(x) for x in zip(*held)), bits, split)
                    held, many = [], 0
        if held:
            yield _blocks(*(np.concatenate(x) for x in zip(*held)), bits, split)

    def meet(batches: Iterator) -> Iterator:
        share = None
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            begin, size = _runs(number)
            for lo, n in zip(begin.tolist(), size.tolist()):
                if share is None or share.share != int(number[lo]):
                    if share is not None:
                        yield from share.close()
                    share = _Share(int(number[lo]), bits, split, bucket_rows)
                yield from share.add(*(batch.column(c).slice(lo, n).to_pylist() for c in (1, 2, 3)))
        if share is not None:
            yield from share.close()

    signed = recs.select("id", "text", F.xxhash64("field").alias("salt"))
    signed = signed.mapInPandas(sign, "share int, base bigint, sigs binary, entries binary")
    bit = lambda c, b: F.when(F.col(c).bitwiseAND(b) > 0, 1).otherwise(0)
    whole, small = bit("entry", 1), bit("entry", 2)
    # A task takes some four shares, whatever the size of the input.
    counted = signed.repartition(max(1, (1 << split) // 4), "share").sortWithinPartitions("share")
    counted = cut(counted.mapInArrow(meet, "sig bigint, entry bigint, n bigint, later array<bigint>"))
    counted = counted.withColumn("tag", F.shiftrightunsigned("sig", _TAG))
    # The exact bands' candidates under either form, from the entries that share a bucket; a few hundred numbers.
    kinds = [F.sum(F.when(F.col("entry").bitwiseAND(3) == k, 1).otherwise(0)).alias(f"k{k}") for k in range(4)]
    sums = counted.where(F.col("tag") > 0).groupBy("tag", "sig").agg(*kinds)
    both = F.col("k3") * (F.col("k3") - 1) / 2 + F.col("k3") * F.col("k1")  # whole ones, one of them small
    more = F.col("k3") * (F.col("k2") + F.col("k0")) + F.col("k1") * F.col("k2")  # one whole and one small, together or apart
    costs = sums.groupBy("tag").agg(F.sum(both).alias("whole"), F.sum(both + more).alias("deleted"))
    chosen = allocation([tuple(r) for r in costs.collect()], threshold)
    whole_only = [t for t, v in chosen.items() if v == 0]
    kept = (F.col("tag") == 0) | F.col("tag").isin(list(chosen))
    if whole_only:
        kept = kept & (~F.col("tag").isin(whole_only) | (whole == 1))
    entries = counted.where(kept)
    weight = F.when(F.col("sig").bitwiseAND(1) == 1, 2).otherwise(1)
    id_of = lambda c: F.shiftright(c, 2)
    wholes = whole + bit("other", 1)
    enough = (wholes >= F.when(F.col("tag").isin(whole_only), 2).otherwise(1)) if whole_only else (wholes >= 1)
    pairs = (
        entries.where(F.col("n") > 0)
        .select("entry", "tag", F.explode("later").alias("other"), weight.alias("w"))
        .where(enough & (small + bit("other", 2) >= 1))
        .select(id_of("entry").alias("a"), id_of("other").alias("b"), "w")
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.sum("w").alias("w"))
    )
    hot = entries.where(F.col("n") < 0).select("sig", id_of("entry").alias("id")).distinct()
    if hot.limit(1).count():
        hot = hot.join(counted.where(F.col("n") < 0).groupBy("sig").agg(F.count("*").alias("n")), "sig")
        crowded = _crowded(recs, hot, threshold, bucket_rows)
        # A pair may meet once in a crowded bucket and once in a plain one.
        pairs = pairs.where(F.col("w") >= 2).select("a", "b").unionByName(crowded).distinct()
    else:
        pairs = pairs.where(F.col("w") >= 2).select("a", "b")
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = recs.join(_small(ids), "id", "left_semi").select("field", "id", "text")
    left = held.select("field", F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("field").alias("field_b"), F.col("id").alias("b"), F.col("text").alias("text_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets: dict[int, frozenset] = {}

            held = 0

            def grams(i: int, x: str) -> frozenset:
                nonlocal held
                if i not in sets:
                    held += len(x)
                    if held > _HELD:  # a batch's texts may be long: only some sets are kept for other pairs
                        sets.clear()
                        held = len(x)
                    sets[i] = frozenset(x[k : k + GRAM] for k in range(len(x) - GRAM + 1))
                return sets[i]

            out = []
            for i, x, j, y in zip(pdf["a"].tolist(), pdf["text_a"], pdf["b"].tolist(), pdf["text_b"]):
                gx, gy = grams(i, x), grams(j, y)
                both = len(gx & gy)
                out.append(both / (len(gx) + len(gy) - both))
            got = pdf[["field", "a", "b"]].assign(jaccard=np.array(out, dtype=np.float64))
            yield got[got["jaccard"] >= threshold - 1e-12]

    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.col("field") == F.col("field_b"))
        .select("field", "a", "b", "text_a", "text_b")
        .mapInPandas(verify, "field string, a bigint, b bigint, jaccard double")
    )


def _crowded(recs: DataFrame, hot: DataFrame, threshold: float, bucket_rows: int) -> DataFrame:
    """Pairs within crowded buckets that a sketch lets reach the threshold: a, b."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _chunks(pdf):
                grams, begin = gram_sets(part["text"].tolist())
                s = sketches(grams, begin)
                cols = {f"s{i}": s[:, i] for i in range(_SKETCH_LONGS)}
                yield pd.DataFrame({"id": part["id"].to_numpy(), "size": np.diff(begin), **cols})

    names = [f"s{i}" for i in range(_SKETCH_LONGS)]
    drawn = (
        recs.select("id", "text")
        .join(hot.select("id").distinct(), "id", "left_semi")
        .mapInPandas(draw, "id bigint, size bigint, " + ", ".join(f"{n} bigint" for n in names))
    )
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    rows = hot.join(drawn, "id").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "size", *names
    )
    # 256 bits agree with probability (1 + J) / 2; six standard deviations below that at the threshold.
    agree = (1 + threshold) / 2
    least = 256 * agree - 6 * (256 * agree * (1 - agree)) ** 0.5

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x = pdf[pdf["own"] == i]
        y = pdf[pdf["own"] == j]
        sx, sy = x[names].to_numpy().view(np.uint64), y[names].to_numpy().view(np.uint64)
        a, b = [], []
        for r in range(len(x)):
            same = 256 - np.bitwise_count(sy ^ sx[r]).sum(axis=1)
            size = y["size"].to_numpy() / max(1, x["size"].iloc[r])
            ok = np.flatnonzero((same >= least) & (size >= threshold) & (size <= 1 / threshold))
            a.append(np.full(len(ok), x["id"].iloc[r]))
            b.append(y["id"].to_numpy()[ok])
        a, b = np.concatenate(a) if a else np.empty(0, int), np.concatenate(b) if b else np.empty(0, int)
        keep = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()

    return rows.groupBy("sig", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def _linked(
    rows: DataFrame, fields: tuple[str, ...], key: str, threshold: float, bucket_rows: int
) -> tuple[DataFrame, DataFrame]:
    """The pairs between one text of each group of copies (field, a, b, jaccard), and the copies (id, rep, field).

    A text is numbered by its key times the number of fields plus its field's place, so keys lie below 2^60 over the fields.
    """
    named = [F.struct(F.lit(f).alias("field"), normal_form(F.col(f).cast("string")).alias("text")) for f in fields]
    texts = (
        rows.where(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("id"), F.explode(F.array(*named)).alias("x"))
        .select("id", "x.field", "x.text")
        .where(F.length("text") >= GRAM)
        .withColumn("same", F.unhex(F.md5("text")))
    )
    # Fields share the keys, so a text's number is its key and field in one.
    place = F.lit(-1)
    for i, f in enumerate(fields):
        place = F.when(F.col("field") == f, i).otherwise(place)
    texts = texts.withColumn("id", F.col("id") * len(fields) + place)
    # Only hashes are shuffled to find the copies; the texts stay where they are, less those copies.
    member = cut(texts.select("field", "same", "id"))
    groups = member.groupBy("field", "same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    several = cut(member.join(groups.where(F.col("copies") > 1), ["field", "same"]).select("id", "rep", "field"))
    repeated = several.where(F.col("id") != F.col("rep")).select("id")
    # Entries are hashed to 2^16 times as many values as there are entries: what falls together by chance is rare
    # and fails the verification.
    entries = 100 * member.count()
    bits = min(_TAG, 16 + max(16, math.ceil(math.log2(entries + 1))))
    shares = max(8 * rows.sparkSession.sparkContext.defaultParallelism, entries / _SHARED)
    split = min(16, math.ceil(math.log2(shares)))
    found = similar(texts.select("field", "id", "text").join(_small(repeated), "id", "left_anti"), threshold, bucket_rows, bits, split)
    return cut(found), several


def links(
    rows: DataFrame, fields: tuple[str, ...], key: str, threshold: float = 0.7, bucket_rows: int = BUCKET
) -> DataFrame:
    """a, b (keys): pairs that hold together all groups which `pairs` links: those between representatives of copies, and
    every copy with its representative, so a group of n copies costs n rows."""
    found, several = _linked(rows, fields, key, threshold, bucket_rows)
    both = found.select("a", "b").unionByName(several.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    a, b = F.floor(F.col("a") / len(fields)), F.floor(F.col("b") / len(fields))
    return both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()


def pairs(
    rows: DataFrame, fields: tuple[str, ...], key: str, threshold: float = 0.7, bucket_rows: int = BUCKET
) -> DataFrame:
    """All pairs of rows: a, b (keys, a < b), field, jaccard; copies included."""
    found, several = _linked(rows, fields, key, threshold, bucket_rows)
    one = several.select("rep", F.col("id").alias("a"))
    copies = one.join(several.select("rep", F.col("id").alias("b"), "field"), "rep").where(F.col("a") < F.col("b"))
    extra = several.where(F.col("id") != F.col("rep")).select("rep", "id")

    def grown(df: DataFrame, side: str) -> DataFrame:
        other = extra.select(F.col("rep").alias(side), F.col("id").alias("_m"))
        more = df.join(other, side).withColumn(side, F.col("_m")).drop("_m")
        return df.unionByName(more)

    linked = grown(grown(found, "a"), "b")
    out = linked.unionByName(copies.select("field", "a", "b", F.lit(1.0).alias("jaccard")))
    a, b = F.floor(F.col("a") / len(fields)), F.floor(F.col("b") / len(fields))
    return out.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "field", "jaccard").where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """Connected components of (a, b): id, component (its least id).

    Every vertex takes the least label among its neighbours and then its label's label, which halves the
    distances; every round is written to the shared folder, and the labels' sum tells when
    nothing changes any more. Rounds beyond the limit raise an error rather than return part of a result.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        labels = cut(step.join(jump, "label").select("id", F.least("label", "far").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select("id", F.col("label").alias("component"))
        before = now
    raise RuntimeError("components did not settle; raise `rounds`")
