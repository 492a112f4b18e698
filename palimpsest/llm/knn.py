"""The k most similar vectors of every vector, by cosine, within each space (fingerprint, dimensions).

Unit vectors are projected to M dimensions with Gaussian (2-stable) weights. The squared projected difference of
two vectors over their squared distance then follows a chi-square law: with one degree of freedom along each
projected dimension, with M for all of them. A kd-tree over the projections orders the search of each query, and
both forms of the law stop it, with d_k, the distance of its k-th neighbour so far, in place of the distance:
  * leaves: the law along the split dimensions gives the probability that a vector at distance d_k lies in a leaf.
    Leaves come by falling probability, and a query is done when those it has not seen hold less than
    1 - CONFIDENCE together;
  * vectors of a leaf: one is verified in full dimensions only if chi2_M(projected distance² / d_k²) < POINT.
A query that visits a leaf is also shown to the leaf's own vectors, so a pair is missed only if neither visits the
other: at CONFIDENCE a side, a few in ten thousand pairs.

As Spark jobs:
  1. usable vectors are parsed and written once, with their numbers packed without loss (`packed`): decimals of a few
     digits take two or three bytes, and every later reading gives the same doubles;
  2. equal vectors collapse to one with its k + 1 smallest ids, which is all any result can need, so a
     group of copies of any size costs one vector; only hashes are shuffled to find them, results are handed to all
     copies by a join, and the number of a vector tells whether it has copies;
  3. the tree's splits are fitted on the projections of a bounded sample (SAMPLE rows), every row is indexed;
  4. each leaf compares its own vectors, which gives every query a first d_k;
  5. in rounds, queries (not groups of them) are sent to the leaves the test asks for with the d_k of the round
     before, and the finds are merged by query. A task holds a cell, which is a subtree of as many leaves as memory
     allows (CELL_BYTES) and the cores can share: a query travels once to a cell with the list of the leaves it asks for
     there, and not at all to its own. A cell that many queries ask for is copied to several tasks. The
     last round is the one in which the test lets every query stop: the second or third as a rule.
The leaves a query asks for grow with its own test, not with the collection, and the vectors sent grow with its cells,
not with its leaves; no task sees all vectors.

Only the sample's projections and one median distance per space with a tree reach the driver.

Defined results: null, broken, short, long, non-finite and all-zero vectors are unusable and neither
queries nor neighbours; fewer than k others in a space give fewer rows; cosines equal to 12 decimals are
ordered by id, so results do not depend on the partitioning; a null fingerprint is a space of its own;
repeated ids stay separate rows of the same id and are no neighbours of themselves; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import cut

#: Projected dimensions; even, for the closed form of the chi-square distribution.
M = 12
#: Confidence of the stopping test over leaves, for one side of a pair, and of the test over vectors.
CONFIDENCE, POINT = 0.99, 0.9995
#: Rows the trees are fitted on, over all spaces.
SAMPLE = 120_000
#: Rows a leaf is meant to hold, while the sample allows so many leaves.
LEAF = 512
#: Queries one task compares with a cell, or four for each of its vectors; more are spread over copies of it.
GROUP = 20_000
#: Packed vectors a task holds at once, and decoded ones.
CELL_BYTES, HELD_BYTES = 64_000_000, 64_000_000
#: A cell's finds kept before they are cut to the k best.
FINDS = 2_000_000
_SEED = 20_240_517


def chi2_cdf(x: float, m: int = M) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dims: int) -> np.ndarray:
    """The Gaussian weights of all spaces of `dims` dimensions."""
    return np.random.default_rng([_SEED, dims]).standard_normal((dims, M))


def _numbers(text: str | None, dims: int | None) -> np.ndarray | None:
    """A JSON list of exactly `dims` finite numbers, not all 0; else nothing."""
    if not isinstance(text, str) or dims is None or dims != dims or dims < 1:
        return None
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, list) or len(v) != dims or not all(type(x) in (int, float) for x in v):
        return None
    try:
        a = np.array(v, dtype=np.float64)
    except OverflowError:
        return None
    top = np.abs(a).max()
    return a if np.isfinite(top) and top > 0 else None


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, each computed in the same way whatever rows it stands among."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def parse(text: str | None, dims: int | None) -> np.ndarray | None:
    """The unit vector of a JSON list of exactly `dims` finite numbers, not all 0; else nothing."""
    a = _numbers(text, dims)
    return None if a is None else _units(a[None])[0]


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row's numbers without loss: two bytes of head (decimals p, bytes w a number), then whole numbers over 10^p in
    planes of their lowest, second ... byte, the sign in the lowest bit. Rows that are no such decimals are kept as they
    are (p 255)."""
    out: list = [None] * len(rows)
    left = np.arange(len(rows))
    for p in range(16):
        if not len(left):
            break
        own = rows[left]
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.rint(own * 10.0**p)
            top = np.abs(whole).max(axis=1)
            ok = ((whole / 10.0**p == own).all(axis=1)) & (top < 2.0**46)
        whole = whole[ok].astype(np.int64)
        sign = ((whole << 1) ^ (whole >> 63)).astype("<u8")
        width = np.ones(len(sign), dtype=np.int64)
        for w in range(1, 6):
            width += sign.max(axis=1) >= np.uint64(1 << 8 * w) if len(sign) else 0
        at = left[ok]
        for w in np.unique(width).tolist():
            its = np.flatnonzero(width == w)
            planes = sign[its].view(np.uint8).reshape(len(its), -1, 8)[:, :, :w].transpose(0, 2, 1)
            flat, size, head = planes.tobytes(), w * rows.shape[1], bytes((p, w))
            for i, r in enumerate(at[its].tolist()):
                out[r] = head + flat[i * size : (i + 1) * size]
        left = left[~ok]
    for r in left.tolist():
        out[r] = b"\xff\x08" + rows[r].astype("<f8").tobytes()
    return out


def unpacked(vecs: list[bytes]) -> np.ndarray:
    """The rows of `packed`, all of one number of dimensions."""
    vecs = [bytes(v) for v in vecs]
    if not vecs:
        return np.empty((0, 0))
    heads: dict[bytes, list[int]] = {}
    for i, v in enumerate(vecs):
        heads.setdefault(v[:2], []).append(i)
    out = np.empty((len(vecs), (len(vecs[0]) - 2) // vecs[0][1]))
    for (p, w), at in heads.items():
        raw = np.frombuffer(b"".join([vecs[i] for i in at] if len(at) < len(vecs) else vecs), dtype=np.uint8)
        raw = raw.reshape(len(at), -1)[:, 2:]
        if p == 255:
            out[at] = np.ascontiguousarray(raw).view("<f8")
            continue
        planes = raw.reshape(len(at), w, -1)
        sign = planes[:, 0].astype(np.int64)
        for j in range(1, w):
            sign |= planes[:, j].astype(np.int64) << (8 * j)
        out[at] = ((sign >> 1) ^ -(sign & 1)) / 10.0**p
    return out


def usable(rows: DataFrame, key: str, space: list[str], dims: str, vector: str) -> DataFrame:
    """id, space, vec (`packed`), same (hash of equal vectors of a space)."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vs = [_numbers(t, None if d is None or d != d else int(d)) for t, d in zip(pdf["_v"], pdf["_d"])]
            sizes: dict[int, list[int]] = {}
            for i, v in enumerate(vs):
                if v is not None:
                    sizes.setdefault(len(v), []).append(i)
            for at in sizes.values():
                rows_ = np.array([vs[i] for i in at])
                spaces = pdf["space"].iloc[at].to_numpy()
                yield pd.DataFrame(
                    {
                        "id": pdf["id"].iloc[at].to_numpy(),
                        "space": spaces,
                        "vec": packed(rows_),
                        "same": [
                            hashlib.blake2b(u.tobytes() + str(s).encode(), digest_size=16).digest()
                            for u, s in zip(np.round(_units(rows_), 13) + 0.0, spaces)
                        ],
                    }
                )

    named = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in space]))
    return rows.select(
        F.col(key).cast("bigint").alias("id"), named.alias("space"), F.col(dims).cast("bigint").alias("_d"), F.col(vector).alias("_v")
    ).mapInPandas(run, "id bigint, space string, vec binary, same binary")


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function (to 1e-7), for chi-square probabilities of one degree of freedom."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


class Tree:
    """Splits of one space: a complete binary tree over the projections, and the bounds of every node."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.shift = 0  # leaves of one subtree of 2^shift make a cell
        inner = (1 << depth) - 1
        self.dim = np.zeros(max(1, inner), dtype=np.int64)
        self.at = np.full(max(1, inner), np.inf)
        self.low = np.full((2 * inner + 1, M), -np.inf)
        self.high = np.full((2 * inner + 1, M), np.inf)
        members = {0: np.arange(len(points))}
        for node in range(inner):
            own, left, right = members.pop(node), 2 * node + 1, 2 * node + 2
            for child in (left, right):
                self.low[child], self.high[child] = self.low[node], self.high[node]
            if len(own):
                p = points[own]
                d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                self.dim[node], self.at[node] = d, np.median(p[:, d])
                above = p[:, d] > self.at[node]
                members[left], members[right] = own[~above], own[above]
                self.high[left, d] = self.low[right, d] = self.at[node]
            else:
                members[left] = members[right] = own

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.dim[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)

    def wanted(self, points: np.ndarray, distance: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): for every point the likeliest leaves of a vector at `distance` from it, by falling
        probability, until they hold `confidence` together."""
        rows, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        mass = np.ones(len(points))
        sigma = np.maximum(distance, 1e-9)
        for _ in range(self.depth):
            d = self.dim[node]
            x = points[rows, d]
            lo, at, hi = (_phi((edge - x) / sigma[rows]) for edge in (self.low[node, d], self.at[node], self.high[node, d]))
            share = np.clip((at - lo) / np.maximum(hi - lo, 1e-30), 0, 1)
            rows = np.concatenate((rows, rows))
            mass = np.concatenate((mass * share, mass * (1 - share)))
            node = np.concatenate((2 * node + 1, 2 * node + 2))
            keep = mass > (1 - confidence) / 200
            rows, mass, node = rows[keep], mass[keep], node[keep]
        order = np.lexsort((node, -mass, rows))
        rows, mass, node = rows[order], mass[order], node[order]
        begin = np.searchsorted(rows, rows)
        before = np.cumsum(mass) - mass
        keep = before - before[begin] < confidence
        return rows[keep], node[keep] - ((1 << self.depth) - 1)


def _matrix(vecs) -> np.ndarray:
    return _units(unpacked(vecs))


def _projected(vectors: np.ndarray) -> np.ndarray:
    return vectors @ projection(vectors.shape[1])


def _trees(points: DataFrame, leaf_rows: int) -> dict[str, Tree]:
    """Trees from the sample: rows by the hash of their vectors, so every copy of a job takes the same."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    n, size = points.agg(F.count("*"), F.avg(F.octet_length("vec"))).first()
    step = max(1, -(-n // SAMPLE))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, at in pdf.groupby("space", sort=False).indices.items():
                yield pd.DataFrame({"space": s, "proj": list(_projected(_matrix(pdf["vec"].iloc[at].tolist())))})

    sample = points.where(F.pmod(F.xxhash64("same"), F.lit(step)) == 0).select("space", "vec")
    rows = sample.mapInPandas(project, "space string, proj array<double>").limit(2 * SAMPLE).collect()
    by: dict[str, list] = {}
    for s, p in rows:
        by.setdefault(s, []).append(p)
    out = {}
    for s, ps in by.items():
        depth = int(np.clip(np.round(np.log2(max(1, len(ps) * step / leaf_rows))), 0, np.log2(max(1, len(ps) / 8))))
        if depth:
            out[s] = Tree(np.array(ps), depth)
            # As many cells as memory asks for, and four to each core.
            cells = len(ps) * step * max((size + 100) / CELL_BYTES, 4 * cores / n)
            out[s].shift = depth - int(np.clip(np.ceil(np.log2(max(1, cells))), 0, depth))
    return out


def _top(who: np.ndarray, cos: np.ndarray, first: np.ndarray, no: np.ndarray, k: int) -> np.ndarray:
    """The positions of each one's `k` best, by cosine, then smallest id."""
    order = np.lexsort((no, first, -cos, who))
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who) < k]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors to 12 decimals, summed in the same way wherever a pair meets."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 20_000):
        out[lo : lo + 20_000] = (a[lo : lo + 20_000] * b[lo : lo + 20_000]).sum(axis=1)
    return np.round(np.minimum(out, 1.0), 12)


def _pairs(qv, qp, least_q, data, dp, least_d, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the pairs that either side can use: those the chi-square test over vectors lets be
    verified and whose cosine reaches the k-th so far (`least`) of one of them."""
    out_q, out_d, out_c = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    far_q, far_d = 2 - 2 * least_q, 2 - 2 * least_d
    for lo in range(0, len(qv), 512):
        q, p = qv[lo : lo + 512], qp[lo : lo + 512]
        near = (p * p).sum(axis=1)[:, None] + (dp * dp).sum(axis=1) - 2 * p @ dp.T
        may = near <= reach * np.maximum(far_q[lo : lo + 512, None], far_d) + 1e-9
        at, col = np.nonzero(may)
        if len(at) > may.size / 20:  # many: one product of matrices is cheaper
            cos = q @ data.T
            at, col = np.nonzero(may & (cos >= np.minimum(least_q[lo : lo + 512, None], least_d) - 1e-9))
        cos = _exact(q[at], data[col])
        use = (cos >= least_q[lo + at]) | (cos >= least_d[col])
        out_q.append(at[use] + lo)
        out_d.append(col[use])
        out_c.append(cos[use])
    return np.concatenate(out_q), np.concatenate(out_d), np.concatenate(out_c)


_BEST = "bc array<double>, bi array<bigint>, bn array<bigint>"  # minus cosine, smallest id, number; in this order


def _lists(who: np.ndarray, cos: np.ndarray, first: np.ndarray, no: np.ndarray, k: int) -> pd.DataFrame:
    """Each one's `k` best: who and the columns of `_BEST`."""
    top = _top(who, cos, first, no, k)
    who = who[top]
    begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, dtype=np.int64)
    cut = lambda x: pd.Series(np.split(x[top], begin[1:]) if len(begin) else [], dtype=object)
    return pd.DataFrame({"no": who[begin], "bc": cut(-cos), "bi": cut(first), "bn": cut(no)})


class _Cell:
    """The vectors of a cell in order of their leaves, as one task holds them, and what queries found for them."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        self.leaf = rows["leaf"].to_numpy()
        self.vecs = rows["vec"].tolist()
        self.no, self.first, self.least = (rows[c].to_numpy() for c in ("no", "first", "least"))
        self.decoded: dict[int, tuple] = {}
        self.bytes = 0
        self.finds: list = []
        self.many = 0

    def at(self, leaf: int) -> tuple:
        """Where a leaf's rows begin, its vectors and their projections."""
        if leaf not in self.decoded:
            lo, hi = np.searchsorted(self.leaf, (leaf, leaf + 1))
            v = _matrix(self.vecs[lo:hi]) if hi > lo else np.empty((0, 1))
            if self.bytes > HELD_BYTES:
                self.decoded, self.bytes = {}, 0
            self.bytes += v.nbytes
            self.decoded[leaf] = (lo, v, _projected(v) if hi > lo else v)
        return self.decoded[leaf]

    def visited(self, part: pd.DataFrame, reach: float, k: int) -> pd.DataFrame:
        """What the queries of `part` find in the leaves they ask for; what is found for the vectors there is kept."""
        asked = part["leaves"].tolist()
        who = np.repeat(np.arange(len(part)), [len(x) for x in asked])
        mine: list = [[np.empty(0, dtype=np.int64)] for _ in range(4)]
        if len(who):
            leaf = np.concatenate([np.asarray(x, dtype=np.int64) for x in asked])
            order = np.argsort(leaf, kind="stable")
            who, leaf = who[order], leaf[order]
            no, first, least = (part[c].to_numpy() for c in ("no", "first", "least"))
            qv = _matrix(part["vec"].tolist())
            qp = _projected(qv)
            starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
            for lo, hi in zip(starts, np.append(starts[1:], len(leaf))):
                begin, v, p = self.at(int(leaf[lo]))
                if not len(v):
                    continue  # a leaf without vectors
                own, rows = who[lo:hi], slice(begin, begin + len(v))
                q, d, cos = _pairs(qv[own], qp[own], least[own], v, p, self.least[rows], reach)
                q, d = own[q], begin + d
                ok = cos >= least[q]
                for kept, x in zip(mine, (no[q[ok]], cos[ok], self.first[d[ok]], self.no[d[ok]])):
                    kept.append(x)
                ok = cos >= self.least[d]
                self.finds.append((self.no[d[ok]], cos[ok], first[q[ok]], no[q[ok]]))
                self.many += int(ok.sum())
            if self.many > FINDS:
                found = tuple(np.concatenate(x) for x in zip(*self.finds))
                top = _top(*found, k)
                self.finds, self.many = [tuple(x[top] for x in found)], 0
        return _lists(*(np.concatenate(x) for x in mine), k)

    def found(self, k: int) -> pd.DataFrame:
        none = tuple(np.empty(0, dtype=np.int64) for _ in range(4))
        return _lists(*(np.concatenate(x) for x in zip(none, *self.finds)), k)


def neighbours(
    rows: DataFrame,
    k: int = 5,
    key: str = "vec_no",
    space: tuple[str, ...] = ("fingerprint", "dimensions"),
    dims: str = "dimensions",
    vector: str = "vector_json",
    confidence: float = CONFIDENCE,
    group_rows: int = GROUP,
    leaf_rows: int = LEAF,
) -> DataFrame:
    """(id, neighbour, rank): for each usable row its `k` most similar others, rank from 1."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    base = cut(usable(rows, key, list(space), dims, vector).withColumn("no", F.monotonically_increasing_id() * 2))
    # Groups of equal vectors: each row's id and the number of the one that stands for all, which is made odd.
    groups = base.groupBy("same").agg(F.min("no").alias("rep"), F.count("*").alias("rows"))
    several = cut(base.select("no", "id", "same").join(cut(groups.where(F.col("rows") > 1)), "same").select("no", "id", (F.col("rep") + 1).alias("rep")))
    w = Window.partitionBy("rep").orderBy("id")
    copies = (
        several.withColumn("rn", F.dense_rank().over(w))
        .where(F.col("rn") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    copies = cut(copies.withColumnRenamed("rep", "n"))
    # need: how many of the k are not copies of the vector itself.
    need = F.greatest(F.lit(0), F.lit(k + 1) - F.coalesce(F.size("ids"), F.lit(1))).alias("need")
    points = (
        base.join(several.where(F.col("no") + 1 != F.col("rep")).select("no"), "no", "left_anti")
        .join(copies.select((F.col("n") - 1).alias("no"), "n", "ids"), "no", "left")
        .select(F.coalesce("n", "no").alias("no"), "space", "vec", "same", F.coalesce(F.col("ids")[0], "id").alias("first"), need)
    )
    trees = spark.sparkContext.broadcast(_trees(points, leaf_rows))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = np.zeros(len(pdf), dtype=np.int64)
            for s, at in pdf.groupby("space", sort=False).indices.items():
                if s in trees.value:
                    leaf[at] = trees.value[s].leaf(_projected(_matrix(pdf["vec"].iloc[at].tolist())))
            yield pdf.assign(leaf=leaf)

    state = "no bigint, space string, vec binary, first bigint, need int, leaf int"
    vectors = points.drop("same").mapInPandas(place, state)
    reach = chi2_quantile(POINT)

    def plan(pdf: pd.DataFrame, proj: np.ndarray, least: np.ndarray) -> pd.DataFrame:
        """Of rows of one space, the leaves each query asks for next, and their cells."""
        asked: list = [[] for _ in range(len(pdf))]
        cells: list = [[] for _ in range(len(pdf))]
        tree = trees.value.get(pdf["space"].iat[0])
        at = np.flatnonzero((pdf["need"] > 0).to_numpy())
        if tree and len(at):
            who, leaf = tree.wanted(proj[at], np.sqrt(np.maximum(2 - 2 * least[at], 0)), confidence)
            seen = pdf["seen"].tolist()
            for r, x in zip(at[who].tolist(), leaf.tolist()):
                if x not in seen[r]:
                    asked[r].append(x)
            for r in at.tolist():
                asked[r].sort()
                cells[r] = sorted({x >> tree.shift for x in asked[r]})
        shift = tree.shift if tree else 0
        return pdf.assign(asked=asked, cells=cells, shift=np.int32(shift))

    def last(pdf: pd.DataFrame) -> np.ndarray:
        """The cosine of the last neighbour needed; below any if there are fewer."""
        need, best = pdf["need"].tolist(), pdf["bc"].tolist()
        return np.array([2.0 if not m else -b[m - 1] if len(b) >= m else -1.0 for m, b in zip(need, best)])

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each vector's best among those of its leaf, and what it asks for. A first d_k can be far off, where a vector
        lies beside its neighbours' leaf: the first round takes no more than the leaf's usual one, later rounds the
        query's own."""
        v = _matrix(pdf["vec"].tolist())
        no, first = pdf["no"].to_numpy(), pdf["first"].to_numpy()
        parts = []
        for lo in range(0, len(v), 1024):
            cos = v[lo : lo + 1024] @ v.T
            cos[np.arange(len(cos)), np.arange(lo, lo + len(cos))] = -3
            least = np.partition(cos, -min(k, len(v)), axis=1)[:, -min(k, len(v))] - 1e-9
            at, col = np.nonzero(cos >= np.maximum(least, -2)[:, None])
            parts.append(_lists(no[lo + at], _exact(v[lo + at], v[col]), first[col], no[col], k))
        best = pd.concat(parts).set_index("no").reindex(no)
        rest = pdf[["no", "space", "vec", "first", "need", "leaf"]]
        rest = rest.assign(**{c: [x if isinstance(x, np.ndarray) else [] for x in best[c]] for c in ("bc", "bi", "bn")})
        proj = _projected(v)
        rest = rest.assign(seen=[[x] for x in rest["leaf"]], least=last(rest), proj=[x.tobytes() for x in proj.astype(np.float32)])
        going = rest["need"].to_numpy() > 0
        usual = np.median(rest["least"].to_numpy()[going]) if going.any() else -1.0
        return plan(rest, proj, np.maximum(rest["least"].to_numpy(), usual))

    added = "seen array<int>, least double, proj binary, asked array<int>, cells array<int>, shift int"
    held_all = cut(vectors.groupBy("space", "leaf").applyInPandas(own, f"{state}, {_BEST}, {added}"))
    lists = held_all

    def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, at in pdf.groupby("space", sort=False).indices.items():
                part = pdf.iloc[at]
                part = part.assign(seen=[x.tolist() for x in part["seen"]], least=last(part))
                proj = np.frombuffer(b"".join(part["proj"]), dtype=np.float32).reshape(len(part), M).astype(np.float64)
                yield plan(part, proj, part["least"].to_numpy())

    while trees.value:
        going = lists.where(F.size("asked") > 0)
        if not going.limit(1).count():
            break
        if lists is not held_all:  # of later rounds, few
            going = going.join(held_all.select("no", "vec"), "no")
        # Rows of a cell that any query asks for; a d_k of an earlier round only lets more finds through to the merge.
        held = held_all.withColumn("cell", F.expr("shiftright(leaf, shift)"))
        sent = going.select("space", F.explode("cells").alias("cell")).groupBy("space", "cell").count()
        room = held.groupBy("space", "cell").agg(F.count("*").alias("rows"))
        parts = F.ceil(F.col("count") / F.greatest(F.lit(group_rows), 4 * F.col("rows"))).cast("int").alias("parts")
        parts = F.broadcast(sent.join(room, ["space", "cell"]).select("space", "cell", parts))  # at most as many rows as leaves
        cols = ["space", "cell", "part", "kind", "no", "first", "least", "vec", "leaf", "leaves"]
        held = held.join(parts, ["space", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        come = going.withColumn("cell", F.explode("cells")).join(parts, ["space", "cell"])
        come = come.withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
        come = come.withColumn("leaves", F.expr("filter(asked, x -> shiftright(x, shift) = cell)"))
        if lists is held_all:  # a query is in its own cell already
            come = come.where("shiftright(leaf, shift) <> cell")
            mine = F.pmod(F.xxhash64("no"), F.col("parts")) == F.col("part")
            held = held.withColumn("leaves", F.when(mine, F.expr("filter(asked, x -> shiftright(x, shift) = cell)")))
        else:
            held = held.withColumn("leaves", F.lit(None).cast("array<int>"))
        stream = (
            held.withColumn("kind", F.lit(0)).select(*cols)
            .unionByName(come.withColumn("kind", F.lit(1)).select(*cols))
            .repartition("space", "cell", "part")
            .sortWithinPartitions("space", "cell", "part", "kind", "leaf")
        )

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, rows_, cell = None, [], None

            def ask(cell: _Cell, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
                for lo in range(0, len(part), 10_000):
                    yield cell.visited(part.iloc[lo : lo + 10_000], reach, k)

            def opened() -> Iterator[pd.DataFrame]:
                """The cell, when its last vector has come: they ask for leaves of their own cell first."""
                nonlocal rows_, cell
                if rows_:
                    cell, rows_ = _Cell(pd.concat(rows_, ignore_index=True)), []
                    yield from ask(cell, cell.rows[cell.rows["leaves"].notna().to_numpy()])

            for pdf in batches:
                for g, part in pdf.groupby(["space", "cell", "part", "kind"], sort=False):
                    if g[:3] != at:
                        yield from opened()
                        if cell is not None:
                            yield cell.found(k)
                        at, cell = g[:3], None
                    if g[3] == 0:
                        rows_.append(part)
                        continue
                    yield from opened()
                    if cell is not None:
                        yield from ask(cell, part)
            yield from opened()
            if cell is not None:
                yield cell.found(k)

        found = stream.mapInPandas(visit, f"no bigint, {_BEST}")
        zipped = F.arrays_zip("bc", "bi", "bn").alias("best")
        meta = F.struct("space", "first", "need", "leaf", "proj", F.concat("seen", "asked").alias("seen"))
        merged = (
            lists.select("no", meta.alias("meta"), zipped)
            .unionByName(found.select("no", zipped), allowMissingColumns=True)
            .groupBy("no")
            .agg(F.first("meta", ignorenulls=True).alias("meta"), F.flatten(F.collect_list("best")).alias("best"))
        )
        best = F.slice(F.array_distinct(F.array_sort("best")), 1, k)
        merged = merged.withColumn("best", best).select("no", "meta.*", *[F.col(f"best.{c}").alias(c) for c in ("bc", "bi", "bn")])
        schema = f"no bigint, space string, first bigint, need int, leaf int, proj binary, seen array<int>, {_BEST}"
        rest = "least double, asked array<int>, cells array<int>, shift int"
        lists = cut(merged.select(*[c.split()[0] for c in schema.split(", ")]).mapInPandas(planned, f"{schema}, {rest}"))

    lists = lists.select("no", "first", "bc", "bi", "bn")
    # Odd numbers have copies: theirs and their neighbours' lists are filled up with these.
    alone = (F.col("no") % 2 == 0) & ~F.exists("bn", lambda x: x % 2 == 1)
    plain = lists.where(alone).select(F.col("first").alias("id"), F.col("bi").alias("near"))
    mixed = lists.where(~alone)
    others = mixed.select("no", F.explode(F.arrays_zip("bc", "bi", "bn")).alias("b")).select("no", "b.*")
    others = others.join(copies.withColumnRenamed("n", "bn"), "bn", "left")
    others = others.select("no", F.col("bc").alias("c"), F.coalesce("ids", F.array("bi")).alias("ids"))
    alike = mixed.select(F.col("no").alias("n"), "first").join(copies, "n", "left")
    alike = alike.select(F.col("n").alias("no"), F.lit(-1.0).alias("c"), F.coalesce("ids", F.array("first")).alias("ids"))
    filled = (
        others.unionByName(alike)
        .select("no", "c", F.explode("ids").alias("id"))
        .groupBy("no")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("c", "id"))), 1, k + 1)["id"].alias("near"))
    )
    members = (
        several.select(F.col("rep").alias("no"), "id")
        .unionByName(mixed.where(F.col("no") % 2 == 0).select("no", F.col("first").alias("id")))
    )
    filled = members.join(filled, "no").select("id", "near")
    picked = F.slice(F.filter("near", lambda x: x != F.col("id")), 1, k)
    return (
        plain.unionByName(filled)
        .select("id", F.posexplode(picked).alias("pos", "neighbour"))
        .select("id", "neighbour", (F.col("pos") + 1).alias("rank"))
    )


def brute_force(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = 4_000, query_bytes: int = 64_000_000, **columns: str) -> DataFrame:
    """The exact neighbours of stated queries against all rows: (id, neighbour, rank).

    Queries come in blocks of about `query_bytes` of vectors, each compared with all rows by tasks that keep
    k + 1 per query; the tasks' lists are merged by a window. The driver and the tasks hold one block at a time,
    and no query is left out. For measuring recall.
    """
    from pyspark.sql import Window

    cols = {"key": "vec_no", "dims": "dimensions", "vector": "vector_json"} | columns
    space = ["fingerprint", cols["dims"]]
    asked = cut(usable(queries, cols["key"], space, cols["dims"], cols["vector"]).select("id", "space", "vec"))
    # Eight bytes a number when unpacked; the second byte tells how many it takes packed.
    size = asked.agg(F.sum(F.expr("(octet_length(vec) - 2) * 8 / int(conv(hex(substring(vec, 2, 1)), 16, 10)) + 64"))).first()[0] or 0
    size = math.ceil(size)
    blocks = max(1, -(-size // query_bytes))
    data = usable(rows, cols["key"], space, cols["dims"], cols["vector"])
    if blocks > 1:
        data = cut(data)
    found = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        one, shared = _block_neighbours(data, own, k, block)
        if blocks > 1:
            one = cut(one)
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("id").orderBy(F.col("cos").desc(), "neighbour")
    return (
        found.where(F.col("id") != F.col("neighbour"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("id", "neighbour", "rank")
    )


def _block_neighbours(data: DataFrame, asked: DataFrame, k: int, block: int) -> tuple:
    """id, neighbour, cos: of each task the k + 1 best for every query of one block; and the block's broadcast."""
    rows = asked.collect()
    by: dict[str, tuple] = {}
    for s in {r["space"] for r in rows}:
        own = [r for r in rows if r["space"] == s]
        by[s] = (np.array([r["id"] for r in own]), _matrix([bytes(r["vec"]) for r in own]))
    shared = data.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {s: (np.full((len(q), k + 1), -2.0), np.full((len(q), k + 1), np.iinfo(np.int64).max)) for s, (_, q) in shared.value.items()}
        for pdf in batches:
            for s, part in pdf.groupby("space"):
                for lo in range(0, len(part) if s in best else 0, block):
                    chunk = part.iloc[lo : lo + block]
                    _keep_best(shared.value[s][1], _matrix(chunk["vec"].tolist()), chunk["id"].to_numpy(), *best[s])
        for s, (cos, ids) in best.items():
            ok = cos > -2
            yield pd.DataFrame({"id": np.repeat(shared.value[s][0], k + 1)[ok.ravel()], "neighbour": ids[ok], "cos": cos[ok]})

    return data.mapInPandas(run, "id bigint, neighbour bigint, cos double"), shared


def _keep_best(q: np.ndarray, data: np.ndarray, ids: np.ndarray, best_cos: np.ndarray, best_id: np.ndarray) -> None:
    """Puts the rows of `data` that are among a query's best into its lists: greatest cosine, then smallest id."""
    k = best_cos.shape[1]
    for lo in range(0, len(q), 1024):
        cos = q[lo : lo + 1024] @ data.T
        least = best_cos[lo : lo + 1024, -1] - 1e-9
        if len(data) > k:
            least = np.maximum(least, np.partition(cos, -k, axis=1)[:, -k] - 1e-9)
        at, col = np.nonzero(cos >= least[:, None])
        u = np.unique(at)
        who = np.concatenate((at, np.repeat(u, k)))
        value = np.concatenate((_exact(q[lo + at], data[col]), best_cos[lo + u].ravel()))
        names = np.concatenate((ids[col], best_id[lo + u].ravel()))
        top = _top(who, value, names, names, k)
        best_cos[lo + u] = value[top].reshape(len(u), k)
        best_id[lo + u] = names[top].reshape(len(u), k)
