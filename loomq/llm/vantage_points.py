"""Approximate nearest neighbours by largest inner product: a vantage-point tree for each shard.

Inner products become distances: with M the largest norm, a vector x gets one more component sqrt(M*M - |x|*|x|) and a
query q gets a zero, so that |q' - x'|**2 = |q|**2 + M*M - 2 q.x. A subtree on the far side of a vantage point's sphere
is skipped if factor * |distance - radius| exceeds the query's k-th best distance. Factor 1 is the triangle inequality
and gives exact search; a larger factor skips more. Every vector is indexed, and every shard is searched by every query.

One task builds a shard's tree and keeps it; blocks of queries stream past it, each a row of bounded size, and k
candidates a query leave it. So what is shuffled is the vectors once, and the queries once a shard.

Where no factor is asked for, each shard takes the largest one whose recall, measured on SAMPLE of its own points against
brute force, reaches RECALL; so data that prune badly are searched in full.

Candidates are ordered by score, then by the least id that is not the query's own, in the search as in the result; points
that tie with the k-th are weighed by that id, and none is lost. Equal vectors of a shard are one point with their ids.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do rows
without vec_id. Vectors of different lengths are never compared. Each row is a candidate of its own, also where rows share
a vec_id; no row of the query's vec_id is among its candidates. Equal rows of a query's vec_id ask once; rows of one query
id with different vectors are asked each, and what they find is ranked together. With fewer candidates than k, all are given;
an empty table of either kind gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

#: A shard holds this many vectors at most, and this many bytes of them; a block of queries as well.
SHARD_ROWS, SHARD_BYTES, QUERY_ROWS, QUERY_BYTES = 32_768, 32 << 20, 1024, 1 << 20
LEAF = 512
#: What a shard tries, in turn, where no factor is given: points that it samples, the recall to reach, and the factors.
SAMPLE, RECALL, FACTORS = 64, 0.97, (8.0, 5.6, 4.0, 2.8, 2.0, 1.4, 1.2)
_NONE = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """A vantage-point tree over the distinct rows of a matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
        keys = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
        by_point = np.argsort(inverse, kind="stable")
        self.ids, self.id_starts = ids[by_point], np.concatenate([[0], np.cumsum(np.bincount(inverse))])
        self.points, self.largest = vectors[first], largest
        norms = np.einsum("ij,ij->i", self.points, self.points)
        self.extra = np.sqrt(np.maximum(0.0, largest * largest - norms))
        self.order = np.arange(len(first))
        self.nodes: list[tuple[int, float, int, int, int, int]] = []  # vantage point, radius, left, right, from, to
        self._build(0, len(first), np.random.default_rng(seed))
        self._ready()

    def _ready(self) -> None:
        """What follows from ids, points and order."""
        self.least = self.ids[self.id_starts[:-1]]
        # of each point, the least id after its least one: what counts for the query whose own id is the least
        point_of = np.repeat(np.arange(len(self.points)), np.diff(self.id_starts))
        self.second = np.full(len(self.points), _NONE)
        np.minimum.at(self.second, point_of, np.where(self.ids > self.least[point_of], self.ids, _NONE))
        self.leaf_points = self.points[self.order]  # leaves side by side, so that a leaf is a slice
        self.seen = self.asked = 0  # pairs of query and point that were weighed, and that there are

    def _build(self, a: int, b: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, a, b))
        if b - a <= LEAF:
            return at
        here = self.order[a:b]
        v = int(here[rng.integers(b - a)])
        d = np.sqrt(np.sum((self.points[here] - self.points[v]) ** 2, axis=1) + (self.extra[here] - self.extra[v]) ** 2)
        half = (b - a) // 2
        split = np.argpartition(d, half)
        radius = float(d[split[half]])
        self.order[a:b] = here[split]
        left, right = self._build(a, a + half, rng), self._build(a + half, b, rng)
        self.nodes[at] = (v, radius, left, right, a, b)
        return at

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of queries, by score and then by least id other than its own: scores, those ids and places of its k first points.

        Rows are filled up with a score of -inf.
        """
        n = len(queries)
        self.own, self.queries = own, queries
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.square = self.norms**2 + self.largest**2
        # rounding: of products against scores as given out, and of distances near zero, which are roots of differences
        self.slack = 1e-12 * self.norms * self.largest
        self.far_slack = 1e-7 * np.sqrt(self.square)
        self.scores, self.found_ids, self.found = np.full((n, k), -np.inf), np.full((n, k), _NONE), np.full((n, k), -1, np.int64)
        self.asked += n * len(self.points)
        self._visit(0, np.arange(n), factor)
        return self.scores, self.found_ids, self.found

    def _visit(self, at: int, q: np.ndarray, factor: float) -> None:
        if not len(q):
            return
        v, radius, left, right, a, b = self.nodes[at]
        if v < 0:
            self._leaf(a, b, q)
            return
        d = np.sqrt(np.maximum(0.0, self.square[q] - 2 * (self.queries[q] @ self.points[v])))
        inside = d <= radius
        self._visit(left, q[inside], factor)
        self._visit(right, q[~inside], factor)
        kth = np.sqrt(np.maximum(0.0, self.square[q] - 2 * np.maximum(self.scores[q, -1], -1e300)))
        near = ~np.isfinite(self.scores[q, -1]) | (factor * (np.abs(d - radius) - self.far_slack[q]) <= kth + self.far_slack[q])
        self._visit(right, q[inside & near], factor)
        self._visit(left, q[~inside & near], factor)

    def _leaf(self, a: int, b: int, q: np.ndarray) -> None:
        """Weighs a leaf's points for the queries q against what they have found."""
        k = self.scores.shape[1]
        self.seen += len(q) * (b - a)
        near = self.queries[q] @ self.leaf_points[a:b].T
        bar = self.scores[q, -1]
        if b - a > k:  # a leaf that begins a query's search sets a bar of its own, one point more as its own may go
            first = np.flatnonzero(~np.isfinite(bar))
            if len(first):
                bar = bar.copy()
                bar[first] = np.partition(near[first], b - a - k - 1, axis=1)[:, b - a - k - 1]
        who, place = np.nonzero(near >= (bar - self.slack[q])[:, None])
        if not len(who):
            return
        rows, points = q[who], self.order[a + place]
        ids = np.where(self.least[points] == self.own[rows], self.second[points], self.least[points])
        keep = ids != _NONE
        rows, points, ids, who = rows[keep], points[keep], ids[keep], who[keep]
        step = max(1, (4 << 20) // self.points.shape[1])
        scores = np.concatenate([(self.points[points[i : i + step]] * self.queries[rows[i : i + step]]).sum(axis=1) for i in range(0, len(rows), step)] or [np.zeros(0)])
        touched = np.unique(rows)
        slot = np.searchsorted(touched, rows)
        all_scores = np.concatenate([scores, self.scores[touched].ravel()])
        all_ids = np.concatenate([ids, self.found_ids[touched].ravel()])
        all_points = np.concatenate([points, self.found[touched].ravel()])
        slots = np.concatenate([slot, np.repeat(np.arange(len(touched)), k)])
        order = np.lexsort((all_ids, -all_scores, slots))
        starts = np.searchsorted(slots[order], np.arange(len(touched)))
        best = order[starts[:, None] + np.arange(k)]
        self.scores[touched], self.found_ids[touched], self.found[touched] = all_scores[best], all_ids[best], all_points[best]

    def answer(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of queries, id and score of each query's k nearest but for its own id, best first, ties to smaller ids.

        Each of the k first points gives at most k ids: those of the others come after them.
        """
        queries = np.ascontiguousarray(queries, np.float64)
        scores, _, points = self.search(own, queries, k, factor)
        who, column = np.nonzero(points >= 0)
        points, scores = points[who, column], scores[who, column]
        # ids of a point are in order; its own, if among them, is left out before the cut
        counts = self.id_starts[points + 1] - self.id_starts[points]
        owned = self._count(points, own[who])
        ids = self.ids[_shared.ranges(self.id_starts[points], np.minimum(counts, k + owned))]
        rows, values = (np.repeat(x, np.minimum(counts, k + owned)) for x in (who, scores))
        keep = ids != own[rows]
        rows, ids, values = rows[keep], ids[keep], values[keep]
        order = np.lexsort((ids, -values, rows))
        rows, ids, values = rows[order], ids[order], values[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return rows[nth < k], ids[nth < k], values[nth < k]

    def _count(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How many of each point's ids are ids."""
        out = np.zeros(len(points), np.int64)
        for i in np.flatnonzero((ids >= self.least[points]) & (ids <= self.ids[self.id_starts[points + 1] - 1])).tolist():
            mine = self.ids[self.id_starts[points[i]] : self.id_starts[points[i] + 1]]
            out[i] = np.searchsorted(mine, ids[i], "right") - np.searchsorted(mine, ids[i], "left")
        return out

    def factor_for(self, k: int, recall: float = RECALL, sample: int = SAMPLE) -> float:
        """The largest of FACTORS with which `sample` of the points find `recall` of their k nearest; 1 if none does.

        Points are taken evenly by least id, so the choice depends on the shard's rows alone.
        """
        n = len(self.points)
        if n <= LEAF:
            return 1.0
        seen, asked = self.seen, self.asked
        picked = np.argsort(self.least, kind="stable")[np.linspace(0, n - 1, min(sample, n)).astype(np.int64)]
        own, queries = self.least[picked], self.points[picked]
        row = np.arange(len(picked))[:, None] * n

        def found(factor: float) -> np.ndarray:
            points = self.search(own, queries, k, factor)[2]
            return (points + row)[points >= 0]

        out, wanted = 1.0, found(1.0)
        for factor in FACTORS:
            if np.isin(wanted, found(factor)).sum() >= recall * len(wanted):
                out = factor
                break
        self.seen, self.asked = seen, asked
        return out


    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, id_starts=self.id_starts, points=self.points, order=self.order, nodes=np.array(self.nodes, np.float64), largest=np.array(self.largest))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        self, held = cls.__new__(cls), np.load(io.BytesIO(data))
        self.ids, self.id_starts, self.points, self.order = (held[x] for x in ("ids", "id_starts", "points", "order"))
        self.largest = float(held["largest"])
        self.nodes = [(int(v), r, int(x), int(y), int(a), int(b)) for v, r, x, y, a, b in held["nodes"].tolist()]
        self._ready()
        return self


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def packed(asked: DataFrame, query_rows: int, element: str) -> DataFrame:
    """(dim, ids, vectors) blocks of the rows of asked (vec_id, embedding, dim), each batch by itself: nothing is shuffled."""
    number = "<f4" if element == "float" else "<f8"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            out = []
            for dim in np.unique(dims).tolist():
                here = b.filter(pa.array(dims == dim))
                step = max(1, min(query_rows, QUERY_BYTES // (8 * dim)))
                for k in range(0, here.num_rows, step):
                    part = here.slice(k, step)
                    out.append((dim, part.column(0).to_numpy().astype("<i8").tobytes(), _matrix(part.column(1), dim).astype(number).tobytes()))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=("dim", "ids", "vectors"))

    return _shared.arrow(asked.select("vec_id", "embedding", "dim"), pack, "dim int, ids binary, vectors binary")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, factor: float | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest of vectors, its own vec_id left out.

    Both tables are (vec_id, embedding). shard_rows and query_rows bound what one task holds at a time. factor: None lets
    each shard choose; 1 is exact.
    """
    if k < 1 or (factor is not None and factor < 1):
        raise ValueError("factor and k must be 1 or more")
    spark = vectors.sparkSession
    element = "float" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (vectors, queries)) else "double"
    number = "<f4" if element == "float" else "<f8"

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast(f"array<{element}>").alias("embedding"))
        return df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))

    held, asked = clean(vectors), clean(queries)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m"), F.max("dim").alias("dim")).first()
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * (size.dim or 1))))
    shards, largest = max(1, math.ceil(size.n / shard_rows)), math.sqrt(size.m or 0.0) * (1 + 1e-12)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of shard, length, and vectors before blocks of queries: one shard's vectors of one length are held at a time."""
        at = tree = None
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        use = factor
        for b in batches:
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            asking = np.asarray(b.column(4).is_valid())
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (asking[1:] != asking[:-1])]) if len(keys) else []
            for s, e in zip(edges, [*edges[1:], len(keys)], strict=True):
                if at != (at := tuple(keys[s].tolist())):
                    rows, tree = [], None
                part = b.slice(s, e - s)
                if not asking[s]:
                    rows.append((part.column(2).to_numpy(), _matrix(part.column(3), at[1])))
                    continue
                if not rows:
                    continue  # nothing of this length in this shard
                if tree is None:
                    tree = Tree(np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows]), largest)
                    rows = [(np.zeros(0, np.int64), np.zeros((0, at[1])))]
                    use = tree.factor_for(k) if factor is None else factor
                for ids, raw in zip(part.column(4), part.column(5), strict=True):
                    own = np.frombuffer(ids.as_buffer(), "<i8")
                    who, found, scores = tree.answer(own, np.frombuffer(raw.as_buffer(), number).reshape(len(own), at[1]), k, use)
                    yield pa.record_batch([pa.array(own[who]), pa.array(found), pa.array(scores)], schema=schema)

    none = lambda t: F.lit(None).cast(t)
    shard = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    points = held.select(shard.alias("shard"), "dim", "vec_id", "embedding", none("binary").alias("ids"), none("binary").alias("vectors"))
    blocks = _shared.written(packed(asked.dropDuplicates(["vec_id", "embedding"]), query_rows, element), "blocks")
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", none("long").alias("vec_id"), none(f"array<{element}>").alias("embedding"), "ids", "vectors")
    rows = points.union(blocks).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", F.col("ids").isNotNull())
    found = _shared.arrow(rows, search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
