"""Near-duplicate vectors by a dual traversal of cover trees.

Vectors of length one are as near as their angle is small: cosine >= t means a distance
of at most sqrt(2 - 2t). The top of the tree comes from a bounded sample: points taken farthest
first are nested nets, the points taken at a distance over a radius being the net of that
radius. Each of them roots a subtree, of the vectors nearest to it. Subtrees that lie beside each other in the tree
share a page, as far as they fit; a subtree larger than a page is dealt into pages. Covering radii are taken over all
vectors, and pages none of whose subtrees come within both radii and the distance sought never meet.

Every page grows its cover tree once: a node's children are a net of half its covering radius, down to
single vectors or a few. For a pair of pages the two trees are walked together: node pairs out of reach
are pruned, node pairs wholly within reach are linked unseen, leaves are compared exactly. A pair of
pages returns counts for each vector and the classes it joins, never the links one by one.

Vectors are shuffled once, to their pages, at the precision they came in; all else goes by 128-bit hashes of them. A page
is a file in the shared folder, and a task reads those that it compares: disk grows with the vectors, not with the pairs of pages.
"""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from inkfield.llm.common import Written, arrow_map, drop_path, new_path, pick
from inkfield.llm.linkage import components
from inkfield.llm.tokenfile import filesystem
from inkfield.llm.vectors import matrix, numbered_vectors, sample, small_batches

SAMPLE = 4096  # vectors the top of the tree is made of
SUBTREES = 1024  # subtrees at most
PAGE = 2048  # vectors of a page, about
TOGETHER = 16  # pages a side that a task holds at a time, at most: every page is read that many times less
SIDES = 8  # groups of pages at least, if there are so many pages
TASKS = 4096  # tasks that pairs of groups are dealt to, at most
SEEN = 1 << 20  # hashes that a task knows copies by
LEAF = 4  # vectors of a leaf at most, unless they are all equal but for rounding
EDGE = 1e-7  # what bounds on distances give way, for rounding
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("first", "<i4"), ("last", "<i4"), ("radius", "<f8")])


def tops(points: np.ndarray, most: int) -> np.ndarray:
    """Points taken farthest first until the rest lies within 1e-3 or there are `most`; in the order of the tree they make.

    The parent of a point is the nearest one of a net of at least twice the radius at which the point was taken.
    """
    chosen, taken = [0], [4.0]
    least = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)) and least.max() > 1e-3:
        at = int(least.argmax())
        chosen.append(at)
        taken.append(float(least[at]))
        least = np.minimum(least, np.linalg.norm(points - points[at], axis=1))
    found, level = points[chosen], np.floor(np.log2(taken))
    kids: list[list[int]] = [[] for _ in chosen]
    for i in range(1, len(chosen)):
        above = max(1, int((level[:i] > level[i]).sum()))
        kids[int(np.linalg.norm(found[:above] - found[i], axis=1).argmin())].append(i)
    order, todo = [], [0]
    while todo:
        order.append(todo.pop())
        todo += reversed(kids[order[-1]])
    return found[order]


def grown(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cover tree of a page: the order of its rows, and nodes over ranges of them, children side by side.

    Children cover at most half the radius that their parent does; single vectors come last among them.
    """
    away = np.sqrt(np.maximum(2 - 2 * (points @ points.T), 0))
    order, nodes = np.arange(len(points)), [(0, len(points), 0, 0, 0, float(away[0].max()))]
    for i, (start, end, head, _, _, radius) in enumerate(nodes):  # the list grows while it is walked; centres are rows as given
        if end - start <= LEAF or radius <= 1e-6:
            continue
        left, groups, centre = order[start:end], [], head
        while len(left):
            near = away[head, left] <= radius / 2
            near[left == head] = True
            groups.append((head, left[near]))
            left = left[~near]
            head = left[0] if len(left) else None
        groups.sort(key=lambda g: len(g[1]) == 1)
        nodes[i] = (start, end, centre, len(nodes), len(nodes) + len(groups), radius)
        at = start
        for head, rows in groups:
            order[at : at + len(rows)] = rows
            nodes.append((at, at + len(rows), head, 0, 0, float(away[head, rows].max()) if len(rows) > 1 else 0.0))
            at += len(rows)
    place = np.argsort(order)
    return order, np.array([(start, end, place[c], *rest) for start, end, c, *rest in nodes], NODE)


class Tree:
    """A page's vectors in the order of its nodes."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray):
        self.points, self.rough, self.nodes = points, points.astype(np.float32), nodes

    def parts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes below node i, or itself: those of several vectors and those of one."""
        node = self.nodes[i]
        kids = np.arange(node["first"], node["last"]) if node["last"] else np.array([i])
        lone = self.nodes["end"][kids] - self.nodes["start"][kids] == 1
        return kids[~lone], kids[lone]

    def rows(self, i: int) -> slice:
        return slice(*self.nodes[i][["start", "end"]].item())


def compare_rows(a: Tree, b: Tree, rows: np.ndarray, others: np.ndarray, cosine: float, hit: np.ndarray) -> int:
    """Marks the rows within reach, in double precision; single precision leaves out most. Returns the pairs looked at."""
    if not len(rows) or not len(others):
        return 0
    slack = a.points.shape[1] * 2.0**-22
    p, q = np.nonzero(a.rough[rows] @ b.rough[others].T >= np.float32(cosine - slack))
    p, q = rows[p], others[q]
    for i in range(0, len(p), 1 << 14):
        x, y = a.points[p[i : i + (1 << 14)]], b.points[q[i : i + (1 << 14)]]
        dots = np.einsum("ij,ij->i", x, y)
        found = dots >= cosine
        for k in np.flatnonzero(np.abs(dots - cosine) < 1e-12).tolist():  # rounding decides: once more with an exact sum
            found[k] = math.fsum(x[k] * y[k]) >= cosine
        hit[p[i : i + (1 << 14)][found], q[i : i + (1 << 14)][found]] = True
    return len(rows) * len(others)


def compare_lone(a: Tree, rows: np.ndarray, cosine: float, hit: np.ndarray) -> int:
    """Rows with those that come after them, a strip at a time."""
    return sum(compare_rows(a, a, rows[i : i + 256], rows[i:], cosine, hit) for i in range(0, len(rows), 256))


def walk(a: Tree, b: Tree, reach: float, cosine: float, hit: np.ndarray) -> int:
    """Marks in hit the rows of a and b whose cosine is at least the threshold; of a tree with itself each pair at least one
    way round. Returns how many distances it took."""
    todo, looked = [(0, 0)], 0
    while todo:
        i, j = todo.pop()
        same = a is b and i == j
        if not a.nodes["last"][i] and not b.nodes["last"][j]:
            looked += compare_rows(a, b, np.arange(*a.rows(i).indices(len(hit))), np.arange(*b.rows(j).indices(hit.shape[1])), cosine, hit)
            continue
        (groups, lone), (others, alone) = a.parts(i), b.parts(j)
        looked += compare_lone(a, a.nodes["start"][lone], cosine, hit) if same else compare_rows(a, b, a.nodes["start"][lone], b.nodes["start"][alone], cosine, hit)
        for xs, ys in ((groups, others), (groups, alone)) if same else ((groups, others), (groups, alone), (lone, others)):
            if not len(xs) or not len(ys):
                continue
            apart = np.sqrt(np.maximum(2 - 2 * (a.points[a.nodes["centre"][xs]] @ b.points[b.nodes["centre"][ys]].T), 0))
            both = a.nodes["radius"][xs][:, None] + b.nodes["radius"][ys][None]
            looked += apart.size
            inside = apart + both < reach - EDGE
            for p, q in np.argwhere(apart <= both + reach + EDGE).tolist():
                if same and xs is groups and ys is others and p > q:
                    continue
                if inside[p, q]:
                    hit[a.rows(xs[p]), b.rows(ys[q])] = True
                else:
                    todo.append((xs[p], ys[q]))
    return looked


def page_links(ids: tuple, copies: tuple, a: Tree, b: Tree, same: bool, reach: float, cosine: float):
    """Links of two pages: (item, other vectors linked), (item, class) of what has a link, and the distances taken."""
    hit = np.zeros((len(a.points), len(b.points)), bool)
    looked = walk(a, b, reach, cosine, hit)
    if same:
        hit |= hit.T.copy()
        np.fill_diagonal(hit, False)
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit = hit[np.ix_(rows, columns)]
    counts = [(ids[0][rows], hit @ copies[1][columns])] + ([] if same else [(ids[1][columns], copies[0][rows] @ hit)])
    left, right = ids[0][rows].copy(), ids[1][columns].copy()
    while len(left):  # the smallest item of what is joined spreads until nothing changes
        top = np.iinfo(np.int64).max
        to_right = np.minimum(right, np.where(hit, left[:, None], top).min(0))
        to_left = np.minimum(left, np.where(hit, to_right[None, :], top).min(1))
        if same:
            to_left = to_right = np.minimum(to_left, to_right)
        if (to_left == left).all() and (to_right == right).all():
            break
        left, right = to_left, to_right
    joined = np.concatenate((ids[0][rows], ids[1][columns])), np.concatenate((left, right))
    return counts, joined, looked


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def layout(sizes: np.ndarray, page: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit of each subtree, and pages of each unit: a subtree larger than a page is a unit, others share one as far as they fit."""
    unit_of, pages, held = np.zeros(len(sizes), np.int64), [], page + 1
    for i, n in enumerate(sizes.tolist()):
        if n > page or held + n > page:
            pages.append(-(-n // page))
            held = page + 1 if n > page else 0
        held += n
        unit_of[i] = len(pages) - 1
    return unit_of, np.array(pages, np.int64)


def meeting(points: np.ndarray, radii: np.ndarray, unit_of: np.ndarray, reach: float) -> np.ndarray:
    """Pairs of units (the smaller first) some of whose subtrees come within reach of each other."""
    pairs = []
    starts = np.flatnonzero(np.r_[True, unit_of[1:] != unit_of[:-1]])
    for u, (at, end) in enumerate(zip(starts, [*starts[1:], len(unit_of)], strict=True)):
        apart = np.sqrt(np.maximum(2 - 2 * (points[at:end] @ points.T), 0))
        near = (apart <= radii[at:end, None] + radii[None] + reach + EDGE).any(0)
        met = np.flatnonzero(np.logical_or.reduceat(near, starts))
        pairs.append(np.stack((np.full(len(met), u), met))[:, met >= u])
    return np.concatenate(pairs, axis=1)


class Pages:
    """Pages below a path in the shared folder, a file each. What is written last under a number is as good as what was there."""

    HEAD = struct.Struct("<QQQ")  # vectors, nodes, bytes of a component

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)

    def write(self, page: int, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, nodes: np.ndarray) -> None:
        self.fs.create_dir(self.path, recursive=True)
        part = f"{self.path}/{page}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as out:
            out.write(self.HEAD.pack(len(ids), len(nodes), vectors.itemsize))
            for x in (ids, copies, nodes, vectors):
                out.write(np.ascontiguousarray(x).tobytes())
        self.fs.move(part, f"{self.path}/{page}")

    def read(self, page: int) -> tuple[np.ndarray, np.ndarray, Tree]:
        with self.fs.open_input_stream(f"{self.path}/{page}") as file:
            raw = file.read()
        n, nodes, width = self.HEAD.unpack_from(raw)
        at, found = self.HEAD.size, []
        for kind, count in (("<i8", n), ("<i8", n), (NODE, nodes), (f"<f{width}", -1)):
            found.append(np.frombuffer(raw, kind, count, at))
            at += found[-1].nbytes
        return found[0], found[1], Tree(unit(found[3].reshape(n, -1)), found[2])


def nearest_root(x: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The nearest root of each vector, the same one whatever vectors stand beside it: a product's last bits depend on these."""
    dots = x @ roots.T
    home = dots.argmax(1)
    close = dots >= dots[np.arange(len(x)), home][:, None] - 1e-9
    for i in np.flatnonzero(close.sum(1) > 1):
        rivals = np.flatnonzero(close[i])
        home[i] = rivals[np.argmax([math.fsum(x[i] * roots[k]) for k in rivals])]
    return home


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, page: int = PAGE, subtrees: int = SUBTREES, tell=None) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each vector.

    Vectors are linked from the given cosine, in double precision; equal vectors always are. n_links counts the
    other rows linked directly, component_id is the smallest id that links reach. A vector
    that is null, empty, zero or has a null or non-finite component is linked with nothing, and vectors of
    different lengths never are. Rows with a null id count like others but are never kept; a
    component's id is the smallest that is not null. Repeated rows are rows of their own. Other columns are
    ignored; an empty table gives no row. Equal vectors are compared once. The driver holds a sample
    and the subtrees' roots and radii, of fixed size, and the pairs of units that meet, at most
    half of SUBTREES squared for each length. tell, if given, is called with the pairs of different vectors and the distances taken.
    """
    spark = df.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    kind = "float" if pick(df, vector_col).schema[0].dataType == ArrayType(FloatType()) else "double"
    rows = numbered_vectors(df, id_col, vector_col).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    rows = rows.withColumns({"k": F.xxhash64("embedding"), "l": F.xxhash64(F.lit(1), "embedding"), "dim": F.size("embedding")})
    fine = rows.where("embedding is not null")
    ids = Written(rows.select("vec_id", *[F.when(F.col("embedding").isNotNull(), F.col(c)).alias(c) for c in ("k", "l", "dim")]), "ids")
    grouped = ids.read().where("dim is not null").groupBy("k", "l", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    items = Written(grouped.withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = dict(items.read().groupBy("dim").count().collect())
    if not sizes:
        return told(ids, None, None, None)
    roots = {d: tops(unit(sample(fine.where(F.col("dim") == d).dropDuplicates(["k", "l"]), "k", SAMPLE, n)[1]), subtrees) for d, n in sizes.items()}
    shipped = spark.sparkContext.broadcast(roots)

    def homes():
        seen = set()

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            if len(seen) > SEEN:
                seen.clear()
            fresh = []
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(fresh))
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(dims == d)
                x = unit(matrix(part.column(0)))
                home = nearest_root(x, shipped.value[d])
                away = np.linalg.norm(x - shipped.value[d][home], axis=1)
                yield {"k": part.column(1), "l": part.column(2), "embedding": part.column(0), "dim": part.column(3), "cell": home, "away": away}

        return step

    placed = Written(arrow_map(fine.select("embedding", "k", "l", "dim"), homes, f"k long, l long, embedding array<{kind}>, dim int, cell int, away double"), "cells")
    homes_of = placed.read().groupBy("k", "l", "dim", "cell").agg(F.max("away").alias("away"))
    found = homes_of.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    cells, pairs, base = [], [], 0
    for d in sizes:
        own = sorted((r for r in found if r.dim == d), key=lambda r: r.cell)
        unit_of, pages = layout(np.array([r.n for r in own]), page)
        starts = base + np.cumsum(pages) - pages  # numbers of the units' first pages
        cells += [(d, r.cell, int(starts[u]), int(pages[u])) for r, u in zip(own, unit_of, strict=True)]
        met = meeting(roots[d][[r.cell for r in own]], np.array([r.radius for r in own]), unit_of, reach)
        pairs.append(pa.table({"a": starts[met[0]], "to_a": (starts + pages)[met[0]] - 1, "b": starts[met[1]], "to_b": (starts + pages)[met[1]] - 1}))
        base += int(pages.sum())
    at = F.broadcast(spark.createDataFrame(cells, "dim int, cell int, first long, pages long"))
    dealt = lambda some: some.join(at, ["dim", "cell"]).withColumn("page", F.col("first") + F.pmod("k", F.col("pages")))
    vectors = dealt(placed.read()).select("page", "dim", F.struct("k", "l").alias("key"), "embedding", F.lit(None).cast("struct<k:long,l:long,item:long,copies:long>").alias("known"))
    known = dealt(homes_of.join(items.read().drop("dim"), ["k", "l"])).select("page", "dim", F.lit(None).cast("struct<k:long,l:long>").alias("key"), F.lit(None).cast(f"array<{kind}>").alias("embedding"), F.struct("k", "l", "item", "copies").alias("known"))
    listed = vectors.unionByName(known).groupBy("page").agg(F.first("dim").alias("dim"), F.collect_list("key").alias("keys"), F.collect_list("embedding").alias("vectors"), F.collect_list("known").alias("known"))
    path = new_path(spark, "pages")

    def grow():
        kept = Pages(path)

        def step(batch):
            for i in range(batch.num_rows if batch is not None else 0):
                keys, known = batch.column(2)[i].values, batch.column(4)[i].values
                k, l, item, copies = (known.field(c).to_numpy() for c in range(4))
                one = {key: at for at, key in enumerate(zip(*(keys.field(c).to_pylist() for c in range(2)), strict=True))}  # copies come from several tasks
                order = np.lexsort((l, k))
                raw = matrix(batch.column(3)[i].values)[[one[key] for key in zip(k[order].tolist(), l[order].tolist(), strict=True)]]
                rows, nodes = grown(unit(raw))
                kept.write(batch.column(0)[i].as_py(), item[order][rows], copies[order][rows], raw[rows], nodes)
                yield {"page": batch.column(0).slice(i, 1)}

        return step

    with small_batches(spark, 2):
        Written(arrow_map(listed, grow, "page long"), "bound").drop()
    placed.drop()
    together = max(1, min(TOGETHER, base // SIDES))
    met = spark.createDataFrame(pa.concat_tables(pairs)).select(F.explode(F.sequence("a", "to_a")).alias("a"), "b", "to_b").select("a", F.explode(F.sequence("b", "to_b")).alias("b")).where("a <= b")
    sides = -(-base // together)
    asked = met.groupBy(F.expr(f"a div {together}").alias("left"), F.expr(f"b div {together}").alias("right")).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    both = asked.select("pairs").repartition(min(TASKS, sides * (sides + 1) // 2))

    def compare():
        kept = Pages(path)

        def step(batch):
            for i in range(batch.num_rows if batch is not None else 0):
                asked = [(pair["a"], pair["b"]) for pair in batch.column(0)[i].as_py()]
                own, looked = {page: kept.read(page) for page in sorted({page for pair in asked for page in pair})}, 0
                for left, right in asked:
                    (ia, na, a), (ib, nb, b) = own[left], own[right]
                    counts, (nodes, classes), n = page_links((ia, ib), (na, nb), a, b, a is b, reach, cosine)
                    looked += n
                    for mine, n in counts:
                        if len(mine):
                            yield {"item": mine, "links": n, "joined": np.full(len(mine), -1)}
                    far = classes != nodes
                    if far.any():
                        yield {"item": nodes[far], "links": np.zeros(far.sum(), np.int64), "joined": classes[far]}
                yield {"item": [-1], "links": [looked], "joined": [-2]}

        return step

    with small_batches(spark, 1):
        links = Written(arrow_map(both, compare, "item long, links long, joined long"), "links")
    drop_path(spark, path)
    if tell:
        tell(sum(n * (n - 1) // 2 for n in sizes.values()), links.read().where("joined = -2").agg(F.sum("links")).first()[0])
    summed = links.read().where("joined = -1").groupBy("item").agg(F.sum("links").alias("links"))
    classes = components(links.read().where("joined >= 0 and joined <> item").select(F.col("item").alias("a"), F.col("joined").alias("b")))
    return told(ids, items, summed, classes)


def told(ids: Written, items: Written | None, summed: DataFrame | None, classes: Written | None) -> DataFrame:
    known = ids.read().where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if items is not None:
        each = items.read().join(summed, "item", "left").join(classes.read().withColumnRenamed("node", "item"), "item", "left")
        each = each.withColumn("component", F.coalesce("component", "item"))
        least = each.groupBy("component").agg(F.min("rep").alias("component_id"))
        each = each.join(least, "component").select("k", "l", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        known = known.unionByName(ids.read().where("dim is not null").join(each, ["k", "l"]).select("vec_id", "n_links", "component_id"))
    return known.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
