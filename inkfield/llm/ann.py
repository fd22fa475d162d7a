"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample by k-means whose large clusters are split until sizes are
balanced. Every vector is posted to its nearest centroid and, if it lies near a boundary, to
more of them. Lists that outgrow a page are kept in several pages, none is cut off.
A query walks a neighbour graph of the centroids held in memory, best first, and takes all
lists that a ratio of distances keeps: from the nearest list on, in squares, up to a share of the way to
the mean distance of all centroids, which is known in closed form; and further lists until they
hold a fixed number of different ids. The vectors of the sample that lie in the lists of a
query bound what each list has to return; the answer itself comes from the lists alone.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import Written, arrow_map
from inkfield.llm.vectors import matrix, numbered_vectors, sample, small_batches

SAMPLE = 32_768  # vectors the index is fitted on
LIST = 50  # vectors a list has on average, as long as there are few enough lists
MOST_LISTS = 4_096
REPLICAS = 4  # lists a vector is posted to at most, its own among them
BOUNDARY = 1.08  # a further list is as near as that times the nearest
RATIO = 0.58  # share of the way from the nearest list to the mean one, in squares, that is searched
LEAST_SEEN = 512  # different ids in the searched lists at least, if there are so many
NEIGHBOURS = 24
PAGE = 1_024
QUERIES = 256  # queries compared with a page at a time
SEED = 7


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None], 0)


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point, a slice of the distances at a time."""
    return np.concatenate([squares(points[i : i + 1024], centres).argmin(1) for i in range(0, len(points), 1024)])


def centroids(points: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """K-means, and then clusters of over twice the mean size are halved along their widest direction."""
    rng = np.random.default_rng(SEED)
    found = points[rng.choice(len(points), min(lists, len(points)), replace=False)].copy()
    for _ in range(rounds):
        home = closest(points, found)
        for k in range(len(found)):
            own = points[home == k]
            if len(own):
                found[k] = own.mean(0)
    home = closest(points, found)
    todo, done = [points[home == k] for k in range(len(found)) if (home == k).any()], []
    most = max(2, 2 * len(points) // max(1, len(found)))
    while todo:
        own = todo.pop()
        middle = own - own.mean(0)
        if len(own) <= most or np.abs(middle).max() < 1e-12 or len(done) + len(todo) >= 2 * lists:
            done.append(own.mean(0))
            continue
        way = middle[np.argmax((middle**2).sum(1))]
        side = middle @ way > np.median(middle @ way)
        if side.all() or not side.any():
            done.append(own.mean(0))
        else:
            todo += [own[side], own[~side]]
    return np.unique(np.array(done), axis=0)


class Graph:
    """Neighbour graph of the centroids; searched best first from a few spread entries.

    sizes: ids of each list, every id counted in one list only.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.middle, self.spread_square = points.mean(0), float((points**2).sum(1).mean())
        m = min(NEIGHBOURS, len(points) - 1)
        linked: list[set] = [set() for _ in points]
        for i in range(0, len(points), 512):
            gaps = squares(points[i : i + 512], points)
            gaps[np.arange(len(gaps)), np.arange(i, i + len(gaps))] = np.inf
            for r, near in enumerate(np.argpartition(gaps, m - 1, axis=1)[:, :m] if m else []):
                for n in near.tolist():
                    linked[i + r].add(n)
                    linked[n].add(i + r)
        self.linked = [np.array(sorted(s), np.int64) for s in linked]
        self.entries = self.spread()

    def spread(self) -> np.ndarray:
        """Entries in every connected part of the graph, and some more of the first."""
        seen, entries = np.zeros(len(self.points), bool), []
        for i in range(len(self.points)):
            if not seen[i]:
                entries.append(i)
                todo = [i]
                seen[i] = True
                while todo:
                    for n in self.linked[todo.pop()].tolist():
                        if not seen[n]:
                            seen[n] = True
                            todo.append(n)
        more = np.linspace(0, len(self.points) - 1, min(16, len(self.points))).astype(np.int64)
        return np.unique(np.concatenate((entries, more)))

    def mean_square(self, q: np.ndarray) -> float:
        """Mean squared distance of all centroids."""
        return float(q @ q - 2 * q @ self.middle + self.spread_square)

    def lists(self, q: np.ndarray, ratio: float, least: int = LEAST_SEEN) -> list[int]:
        """Lists from the nearest found up to `ratio` of the way to the mean, and more until `least` ids are seen."""
        seen = np.zeros(len(self.points), bool)
        seen[self.entries] = True
        gaps = ((self.points[self.entries] - q) ** 2).sum(1)
        heap = list(zip(gaps.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        best, far, out = np.inf, self.mean_square(q), []
        patience = held = 0
        while heap:
            gap, at = heapq.heappop(heap)
            best = min(best, gap)
            out.append((gap, at))
            held += self.sizes[at]
            if gap > best + ratio * max(far - best, 0.0):
                patience += 1
                if patience > 8 and held >= least:
                    break
            near = self.linked[at][~seen[self.linked[at]]]
            if len(near):
                seen[near] = True
                for item in zip(((self.points[near] - q) ** 2).sum(1).tolist(), near.tolist(), strict=True):
                    heapq.heappush(heap, item)
        found, total = [], 0
        for gap, at in sorted(out):
            if gap > best + ratio * max(far - best, 0.0) and total >= least:
                break
            found.append(at)
            total += self.sizes[at]
        return found


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, ratio: float = RATIO, list_size: int = LIST, most_lists: int = MOST_LISTS, sample_size: int = SAMPLE, least: int = LEAST_SEEN, tell=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows of another
    id. score is the Euclidean distance of the original vectors in double precision; rank
    counts from 1, ties go to the smaller id. All candidates are given if there are fewer than k. Vectors that are null, empty,
    zero or have a null or non-finite component take no part, nor do rows with a null id or with another
    length than most vectors have. Rows that repeat an id and a vector count once; of one id with
    different vectors the nearest counts as a candidate, and the least (component by component) asks as a query. Other
    columns are ignored; an empty table gives no row. The driver holds the
    sample, centroids and list sizes, of fixed size. tell, if given, is called with the mean share of the ids that a
    query's lists hold, ids in several lists counted as often.
    """
    spark = df.sparkSession
    rows = numbered_vectors(df, id_col, vector_col).where("embedding is not null and vec_id is not null")
    largest = F.max(F.array_max(F.transform("embedding", F.abs)))
    sizes = sorted(((n, -d, top) for d, n, top in rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*"), largest).collect()), reverse=True)
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, dim, scale = sizes[0][0], -sizes[0][1], 2.0 ** max(0, math.frexp(sizes[0][2])[1] - 400)  # a power of two: squares stay finite
    rows = rows.where(F.size("embedding") == dim)
    if scale > 1:
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x / scale))
    ids, some = sample(rows, "vec_id", sample_size, total)
    if not len(some):  # by chance none of a few rows
        ids, some = sample(rows, "vec_id", total, total)
    middle = centroids(some, int(np.clip(total // list_size, 1, most_lists)))
    shipped = spark.sparkContext.broadcast(middle)

    def post():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            x, c = matrix(batch.column(1)), shipped.value
            for i in range(0, len(x), 2048):
                gaps = np.sqrt(squares(x[i : i + 2048], c))
                order = np.argsort(gaps, axis=1, kind="stable")[:, :REPLICAS]
                near = np.take_along_axis(gaps, order, 1)
                chosen = near <= BOUNDARY * near[:, :1]
                chosen[:, 0] = True
                row, col = np.nonzero(chosen)
                part = batch.slice(i, 2048).take(pa.array(row))
                yield {"list": order[row, col], "home": col == 0, "vec_id": part.column(0), "embedding": part.column(1)}

        return step

    posted = Written(arrow_map(rows, post, "list int, home boolean, vec_id long, embedding array<double>"), "postings")
    counts, alone = np.zeros(len(middle), np.int64), np.zeros(len(middle), np.int64)
    for r in posted.read().groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    homes = posted.read().where("home").groupBy("vec_id").agg(F.min("list").alias("list"))
    for r in homes.groupBy("list").count().collect():
        alone[r["list"]] = r["count"]
    picked = F.broadcast(spark.createDataFrame(pa.table({"vec_id": np.unique(ids)})))
    held_by = posted.read().where("home").join(picked, "vec_id").groupBy("vec_id").agg(F.min(F.struct("list", "embedding")).alias("at")).collect()
    held_by.sort(key=lambda r: (r["at"]["list"], r["vec_id"]))
    known = np.array([r["vec_id"] for r in held_by], np.int64)
    points = np.array([r["at"]["embedding"] for r in held_by], np.float64)
    ends = np.searchsorted([r["at"]["list"] for r in held_by], np.arange(len(middle) + 1))
    index = spark.sparkContext.broadcast((Graph(middle, alone), known, points, ends))
    least = max(least, k) + 1  # the query's own id is among them

    def ask():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            graph, known, points, ends = index.value
            for key, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                lists = graph.lists(q, ratio, least)
                own = np.concatenate([np.arange(ends[at], ends[at + 1]) for at in lists])
                gaps = np.linalg.norm(points[own[known[own] != key]] - q, axis=1)
                bound = float(np.partition(gaps, k - 1)[k - 1]) * (1 + 1e-9) if len(gaps) >= k else 1e308
                yield {"list": lists, "query_id": [key] * len(lists), "query": [q] * len(lists), "bound": [bound] * len(lists)}

        return step

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = Written(arrow_map(queries, ask, "list int, query_id long, query array<double>, bound double"), "asked")
    if tell:
        held = F.create_map(*[F.lit(x) for i, n in enumerate(counts) for x in (i, int(n))])
        tell(asked.read().groupBy("query_id").agg(F.sum(held[F.col("list")]).alias("n")).agg(F.avg("n")).first()[0] / max(1, int(alone.sum())))
    pages = spark.createDataFrame([(i, max(1, -(-int(n) // PAGE))) for i, n in enumerate(counts)], "list int, pages int")
    dealt = posted.read().join(F.broadcast(pages), "list").withColumn("page", F.pmod(F.xxhash64("vec_id"), F.col("pages")))
    held = dealt.groupBy("list", "page").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("embedding").alias("vectors"))
    groups = max(1, total // every // QUERIES)
    blocks = asked.read().withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("list", "block").agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries"), F.collect_list("bound").alias("bounds"))
    met = blocks.join(held, "list").select("query_ids", "queries", "bounds", "ids", "vectors")

    def compare():
        def step(batch):
            if batch is None:
                return
            for i in range(batch.num_rows):
                qi, qs, bounds, vi, vs = (batch.column(c)[i].values for c in range(5))
                qi, q, bounds, vi, v = qi.to_numpy(), matrix(qs), bounds.to_numpy(), vi.to_numpy(), matrix(vs)
                order = np.argsort(vi, kind="stable")
                vi, v = vi[order], v[order]
                gaps = np.sqrt(squares(q, v))
                gaps[qi[:, None] == vi[None]] = np.inf
                starts = np.flatnonzero(np.r_[True, vi[1:] != vi[:-1]])
                if len(starts) > k + 8:  # ties and rounding: some more ids than k, checked exactly below
                    least_gaps = np.minimum.reduceat(gaps, starts, axis=1)
                    bounds = np.minimum(bounds, np.partition(least_gaps, k + 7, axis=1)[:, k + 7])
                a, b = np.nonzero((gaps <= bounds[:, None] + 1e-6) & np.isfinite(gaps))
                yield {"query_id": qi[a], "vec_id": vi[b], "score": np.sqrt(((q[a] - v[b]) ** 2).sum(1))}

        return step

    with small_batches(spark, 16):
        found = Written(arrow_map(met, compare, "query_id long, vec_id long, score double"), "found")
    for t in (posted, asked):
        t.drop()
    once = found.read().groupBy("query_id", "vec_id").agg((F.min("score") * scale).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
