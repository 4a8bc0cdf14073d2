"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test stops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import chi2_quantile
from .shared import Stash

#: Projected dimensions, points in a kd-tree leaf, vectors in a block.
DIMS, LEAF, BLOCK = 16, 64, 16384
#: Chance that a neighbour nearer than the found ones has been met when the search stops.
CONFIDENCE = 0.95
#: Vectors whose projections the cells are fitted on, about; every vector is then put in a cell.
SAMPLE = 1 << 15
#: Verified at once; above this a test may come a little later than it could.
CHUNK = 128


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: the cosine stays the same to
    the last bit, and no square leaves the range of doubles."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def projected(vectors: np.ndarray) -> np.ndarray:
    """Stable projections of the unit vectors of rows that scaled() gave."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return unit @ np.random.default_rng([11, vectors.shape[1]]).standard_normal((vectors.shape[1], DIMS))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The kd-tree's leaves: halves at the median of the widest dimension, down to leaf points."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = np.argpartition(points[rows, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class Cells:
    """The upper levels of the kd-tree: cells of the projected space, split at medians of a sample."""

    def __init__(self, points: np.ndarray, n_cells: int):
        #: Per split: axis, value, and the splits or (as -1 - cell) cells on both sides.
        self.splits: list[list] = []
        low, high = [], []
        todo = [(np.arange(len(points)), np.full(DIMS, -np.inf), np.full(DIMS, np.inf), n_cells, None)]
        while todo:
            rows, lo, hi, wanted, parent = todo.pop()
            values = points[rows]
            axis = int(np.argmax(np.ptp(values, axis=0))) if len(rows) else 0
            cut = float(np.median(values[:, axis])) if len(rows) else 0.0
            right = values[:, axis] > cut if len(rows) else np.zeros(0, bool)
            if wanted < 2 or not right.any():
                name = -1 - len(low)
                low.append(lo)
                high.append(hi)
            else:
                name = len(self.splits)
                self.splits.append([axis, cut, 0, 0])
                mid_hi, mid_lo = hi.copy(), lo.copy()
                mid_hi[axis] = mid_lo[axis] = cut
                todo += [(rows[~right], lo, mid_hi, wanted // 2, (name, 2)), (rows[right], mid_lo, hi, wanted - wanted // 2, (name, 3))]
            if parent:
                self.splits[parent[0]][parent[1]] = name
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64) if self.splits else np.full(len(points), -1)
        for name, (axis, cut, left, right) in enumerate(self.splits):  # a split stands before those below it
            here = np.flatnonzero(at == name)
            at[here] = np.where(points[here, axis] > cut, right, left)
        return -1 - at

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of the point from each cell."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        return (gap * gap).sum(axis=1)


class Block:
    """The kd-tree over the projections of the vectors of a cell, or of a part of a cell of many."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], scaled(vectors[order])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.points = projected(self.vectors)
        self.leaves = kd_leaves(self.points)
        self.low = np.array([self.points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([self.points[r].max(axis=0) for r in self.leaves])
        self.stop = chi2_quantile(CONFIDENCE, DIMS)

    def search(self, own: int, query: np.ndarray, k: int, known: float = -np.inf) -> tuple[list[tuple[int, float]], int]:
        """The k best (vec_id, cosine), and how many vectors were verified.

        Points come in order of projected distance, leaf by leaf. With d the distance of the k-th best unit
        vector so far (known: its cosine from elsewhere), a nearer one lies within d * sqrt(chi-square) in
        projection with the given chance: points beyond that are not verified, and a leaf beyond it ends the search."""
        query = scaled(query[None, :])
        at = projected(query)[0]
        query = query[0]
        norm = np.sqrt((query * query).sum())
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0.0)
        near = (gap * gap).sum(axis=1)
        order = np.argsort(near, kind="stable")
        scores, ids, verified, kth = np.empty(0), np.empty(0, np.int64), 0, known
        # rounding in the projections is far below what is added
        limit = lambda: self.stop * max(0.0, 2.0 - 2.0 * kth) + 1e-9 if kth > -np.inf else np.inf
        first, step = 0, 1
        while first < len(order) and near[order[first]] <= limit():
            rows = np.concatenate([self.leaves[i] for i in order[first : first + step]])
            first, step = first + step, min(2 * step, 32)
            rows = rows[self.ids[rows] != own]
            away = self.points[rows] - at
            away = (away * away).sum(axis=1)
            nearest = np.argsort(away, kind="stable")
            rows, away = rows[nearest], away[nearest]
            for a in range(0, len(rows), CHUNK):
                if away[a] > limit():
                    break
                part = np.sort(rows[a : a + CHUNK][away[a : a + CHUNK] <= limit()])
                verified += len(part)
                got = (self.vectors[part] * query).sum(axis=1) / (self.norms[part] * norm)
                scores, ids = np.concatenate([scores, got]), np.concatenate([ids, self.ids[part]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    kth = max(kth, scores[-1])
        return list(zip(ids.tolist(), scores.tolist())), verified


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def answered(k: int):
    """Of rows sorted by (dim, cell, part), vectors (no known) before queries, the answers to the queries: a
    task holds one part's vectors, and its queries pass by in batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, rows, index = None, [], [], None
        for b in batches:
            out = []
            for named, group in b.groupby(["dim", "cell", "part"], sort=False):
                if named != key:
                    key, ids, rows, index = named, [], [], None
                is_query = group["known"].notna().to_numpy()
                if not is_query.all():
                    stored = group[~is_query]
                    ids.append(stored["vec_id"].to_numpy(np.int64))
                    rows.append(matrix(stored["v"]))
                if is_query.any() and rows:
                    if index is None:
                        index = Block(np.concatenate(ids), np.concatenate(rows))
                        rows = [rows[0][:0]]
                    asked = group[is_query]
                    for own, v, known in zip(asked["vec_id"].tolist(), asked["v"], asked["known"].tolist()):
                        found, verified = index.search(own, np.asarray(v, np.float64), k, known)
                        out.append((own, [i for i, _ in found], [s for _, s in found], verified))
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_ids", "scores", "n_verified"])

    return work


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The k rows of vectors of largest cosine for each row of queries, near enough found.

    vectors, queries: vec_id long, embedding array of float or double; other columns are ignored.
    Returned: query_id, rank int (from 1), vec_id, score double, nearest first, ties to the smaller
    vec_id, and n_verified long, the vectors whose cosine with the query was computed. A query's own vec_id
    is no candidate.

    Every vector is indexed: in the cell of about block vectors that its projection falls in, fitted on the
    projections of about sample vectors, and there in a kd-tree. A cell of more vectors, such as one of
    equal vectors, is dealt over parts. A query first asks its own cell. With the k-th best cosine found there
    it then asks those other cells whose boxes pass the same chi-square test that ends a search within a cell. No
    vector is copied; a task holds the vectors of one part.

    Vectors that are null, empty or zero, or that hold a null or non-finite component, take no part, nor
    does a null vec_id. Vectors meet queries of the same dimension only. Rows that repeat a vec_id are each a candidate;
    a repeated query is answered once. With fewer candidates than k all are returned. An empty table
    gives no rows.
    """

    def usable(rows: DataFrame) -> DataFrame:
        whole = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        return whole.where(F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v"))

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, rows in b.groupby("dim"):
                yield pd.DataFrame({"p": list(projected(scaled(matrix(rows["v"]))))})

    base = Stash(usable(vectors), "vectors")
    asked = Stash(usable(queries).dropDuplicates(["vec_id"]), "queries")
    n = base.df.count()
    # about sample rows, by a hash; of these only the projections come to the driver
    drawn = base.df.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n))) < sample).mapInPandas(points, "p array<double>").collect()
    cells = Cells(np.array([r.p for r in drawn]).reshape(-1, DIMS), -(-n // block))
    stop = chi2_quantile(CONFIDENCE, DIMS)
    sent = vectors.sparkSession.sparkContext.broadcast(cells)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, rows in b.groupby("dim"):
                yield rows.assign(cell=sent.value.of(projected(scaled(matrix(rows["v"])))))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, rows in b.groupby("dim"):
                at = projected(scaled(matrix(rows["v"])))
                home = sent.value.of(at)
                limit = stop * np.maximum(0.0, 2.0 - 2.0 * rows["known"].to_numpy()) + 1e-9
                reached = [np.flatnonzero((sent.value.gaps(p) <= x) & (np.arange(len(cells.low)) != h)) for p, x, h in zip(at, limit, home)]
                yield rows.loc[rows.index.repeat([len(r) for r in reached])].assign(cell=np.concatenate(reached) if reached else [])

    shape = "vec_id long, v array<double>, dim int, cell long"
    stored = Stash(base.df.mapInPandas(placed, shape), "placed")
    base.drop()
    parts = Stash(stored.df.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), "parts")
    dealt = stored.df.join(parts.side(), ["dim", "cell"]).select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), "parts").alias("part"), F.lit(None).cast("double").alias("known"))

    def ask(rows: DataFrame) -> Stash:
        each = rows.join(parts.side(), ["dim", "cell"]).select("vec_id", "v", "dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "known")
        keys = ("dim", "cell", "part")
        met = dealt.union(each).repartition(*keys).sortWithinPartitions(*keys, F.col("known").isNotNull())
        return Stash(met.mapInPandas(answered(k), "query_id long, vec_ids array<long>, scores array<double>, n_verified long"), "answers")

    def ranked(answers: DataFrame) -> DataFrame:
        each = answers.select("query_id", F.explode(F.arrays_zip("scores", "vec_ids")).alias("x")).select("query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ask(asked.df.mapInPandas(placed, shape).withColumn("known", F.lit(float("-inf"))))
    kth = ranked(first.df).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    bounded = asked.df.join(kth, "vec_id", "left").select("vec_id", "v", "dim", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    more = ask(bounded.mapInPandas(routed, "vec_id long, v array<double>, dim int, known double, cell long").select("vec_id", "v", "dim", "cell", "known"))
    answers = first.df.union(more.df)
    verified = answers.groupBy("query_id").agg(F.sum("n_verified").alias("n_verified"))
    return ranked(answers).join(verified, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_verified")
