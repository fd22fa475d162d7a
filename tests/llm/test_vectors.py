import numpy as np
import pytest

from inkfield.llm.ann import Graph, centroids, nearest
from inkfield.llm.covertree import Pages, Tree, grown, layout, meeting, near_vectors, nearest_root, page_links, tops, unit, walk

SCHEMA = "vec_id long, embedding array<double>, VEC_ID string, n_links int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)


def cloud(seed, n, centres, dim, noise):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in middle[i % centres] * (1 + rng.random()) + rng.normal(size=dim) * noise * rng.random()]) for i in range(n)]


ODD = [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] + [1.0] * 11), (9004, [float("inf")] + [1.0] * 11), (9005, [1.0, 2.0]), (9006, [1.0] * 11 + [None])]


def usable(e, dim=12):
    return e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e) and any(e)


def test_near_vectors_against_all_pairs(spark):
    rows = cloud(1, 700, 9, 12, 0.5) + ODD
    rows += [(8000 + i, rows[3][1]) for i in range(40)] + [(7000, [2 * x for x in rows[5][1]])] + [(rows[8][0], rows[8][1])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows), page=150, subtrees=20).collect())
    good = [(i, e) for i, e in rows if usable(e)]
    x = np.array([e for _, e in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    hit |= (x[:, None] == x[None]).all(-1)
    np.fill_diagonal(hit, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(hit, label[None], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    want = [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, hit.sum(1), label, strict=True)]
    want += [(i, 0, i, True) for i, e in rows if not usable(e)]
    assert got == sorted(want)


def test_vectors_of_no_use(spark):
    assert near_vectors(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors(vectors(spark, [(1, None), (2, [0.0])])).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(vectors(spark, [(None, [1.0]), (None, [2.0])])).select("n_links", "component_id", "kept").distinct().collect() == [(1, None, False)]
    assert nearest(vectors(spark, [])).collect() == [] and nearest(vectors(spark, [(0, None), (1, [0.0])])).collect() == []


@pytest.mark.parametrize("noise", [0.02, 0.3, 1.0])
def test_the_walk_finds_exactly_the_close_pairs(noise):
    x = unit(np.array([e for _, e in cloud(2, 500, 4, 8, noise)]))
    y = unit(np.array([e for _, e in cloud(2, 420, 4, 8, noise)])[::-1].copy())
    a, b = planted(x), planted(y)
    hit = np.zeros((len(x), len(y)), bool)
    looked = walk(a, b, (2 - 1.9) ** 0.5, 0.95, hit)
    assert (hit == (a.points @ b.points.T >= 0.95)).all()
    if noise < 0.1:  # clusters that lie apart: node pairs are pruned, and linked as a whole
        assert looked < len(x) * len(y) / 4


def planted(points):
    order, nodes = grown(points)
    return Tree(points[order], nodes)


@pytest.mark.parametrize("noise", [0.001, 0.3, 3.0])
def test_every_node_covers_its_rows_with_half_the_radius_of_its_parent(noise):
    x = unit(np.array([e for _, e in cloud(4, 600, 7, 10, noise)]))
    order, nodes = grown(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    x = x[order]
    for n in nodes:
        away = np.linalg.norm(x[n["start"] : n["end"]] - x[n["centre"]], axis=1)
        assert n["start"] <= n["centre"] < n["end"] and away.max() <= n["radius"] + 1e-7
        kids = nodes[n["first"] : n["last"]]
        if len(kids):
            assert kids["start"].tolist() == [n["start"], *kids["end"][:-1]] and kids["end"][-1] == n["end"]
            assert (kids["radius"] <= n["radius"] / 2 + 1e-7).all()


def test_equal_points_make_one_leaf():
    order, nodes = grown(unit(np.ones((50, 3))))
    assert len(nodes) == 1 and sorted(order.tolist()) == list(range(50))


def test_subtrees_share_pages_and_only_near_units_meet():
    unit_of, pages = layout(np.array([3, 4, 2, 25, 1, 9, 9]), 10)
    assert unit_of.tolist() == [0, 0, 0, 1, 2, 2, 3] and pages.tolist() == [1, 3, 1, 1]
    roots = tops(unit(np.array([[1.0, 0.01 * i] for i in range(20)] + [[0.01 * i, -1.0] for i in range(20)])), 6)
    met = meeting(roots, np.full(len(roots), 0.05), np.arange(len(roots)), 0.1)
    near = {(i, j) for i in range(len(roots)) for j in range(i, len(roots)) if np.linalg.norm(roots[i] - roots[j]) <= 0.2}
    assert set(map(tuple, met.T.tolist())) == near and len(near) < len(roots) * (len(roots) + 1) // 2


def test_clusters_prune_most_pairs(spark):
    told = []
    near_vectors(vectors(spark, cloud(6, 1500, 30, 16, 0.05)), page=200, subtrees=64, tell=lambda *x: told.append(x))
    pairs, looked = told[0]
    assert looked < pairs / 4


def shuffled(spark):
    """Bytes of each shuffle file that there is."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}


def test_shuffles_grow_with_the_vectors_and_not_with_pairs_of_pages(spark):
    x = np.random.default_rng(8).normal(size=(6000, 16))
    rows = vectors(spark, [(i, e) for i, e in enumerate(x.tolist())])
    before = shuffled(spark)
    found = near_vectors(rows, page=60).collect()
    assert len(found) == 6000
    assert sum(n for name, n in shuffled(spark).items() if name not in before) < 5 * x.nbytes


def test_pages_come_back_as_they_were_written(tmp_path):
    rng = np.random.default_rng(9)
    for kind in (np.float32, np.float64):
        x = rng.normal(size=(70, 5)).astype(kind)
        order, nodes = grown(unit(x))
        Pages(f"file://{tmp_path}/some").write(3, order, order + 1, x[order], nodes)
        ids, copies, tree = Pages(f"file://{tmp_path}/some").read(3)
        assert (ids == order).all() and (copies == order + 1).all() and (tree.nodes == nodes).all() and (tree.points == unit(x[order])).all()


def test_the_nearest_root_is_the_same_beside_other_vectors():
    rng = np.random.default_rng(10)
    roots = unit(rng.normal(size=(300, 64)))
    x = unit(np.concatenate((rng.normal(size=(200, 64)), (roots[:100] + roots[100:200]) / 2)))  # half of them as near to two roots
    whole = nearest_root(x, roots)
    assert all((nearest_root(x[i : i + n], roots) == whole[i : i + n]).all() for i, n in ((0, 1), (7, 3), (200, 1), (201, 2), (150, 120), (260, 40)))


def test_vectors_near_the_largest_double(spark):
    rows = [(0, [1e305, 0.0]), (1, [1e305, 0.0]), (2, [0.0, 1.7e308]), (100, [1e305, 1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors(spark, rows)).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 100: (2, 0), 2: (0, 2)}
    found = [(r.query_id, r.vec_id, r.score) for r in nearest(vectors(spark, rows), k=2).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, v, _ in found] == [(0, 1), (0, 100), (100, 0), (100, 1)] and found[0][2] == 0.0 and found[1][2] == pytest.approx(1e300)


def test_pages_return_counts_and_classes():
    tree = planted(unit(np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])))
    counts, (nodes, classes), _ = page_links((np.array([5, 6, 7]), np.array([5, 6, 7])), (np.array([1, 3, 1]), np.array([1, 3, 1])), tree, tree, True, 0.3, 0.95)
    assert dict(zip(*[c.tolist() for c in counts[0]], strict=True)) == {5: 3, 6: 1}
    assert set(zip(nodes.tolist(), classes.tolist(), strict=True)) == {(5, 5), (6, 5)}


def exact(rows, every, k):
    good = [(i, np.array(e)) for i, e in rows if usable(e)]
    out = {}
    for i, e in good:
        if i % every == 0:
            found = sorted((float(np.sqrt(((e - f) ** 2).sum())), j) for j, f in good if j != i)
            out[i] = found[:k]
    return out


def test_nearest_has_recall_and_exact_scores(spark):
    rows = cloud(3, 3000, 40, 12, 1.0) + ODD
    got = {}
    for r in nearest(vectors(spark, rows), every=20, list_size=30, least=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["score"], r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    want = exact(rows, 20, 10)
    assert got.keys() == want.keys()
    by_id = dict(rows)
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        assert all(s == pytest.approx(float(np.sqrt(((np.array(by_id[q]) - np.array(by_id[v])) ** 2).sum())), abs=1e-12) for s, v in found)
    recall = np.mean([len({v for _, v in got[q]} & {v for _, v in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def recall_of(spark, rows, want, **options):
    got = {}
    for r in nearest(vectors(spark, rows), every=20, list_size=30, least=64, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 10 for q in want)
    return np.mean([len(got[q] & {v for _, v in want[q]}) / 10 for q in want])


def test_the_lists_decide_what_is_found(spark):
    rows = cloud(3, 3000, 40, 12, 1.0)
    want = exact(rows, 20, 10)
    shares = []
    assert recall_of(spark, rows, want, sample_size=300, tell=shares.append) >= 0.9
    assert shares[0] < 0.3
    loose = cloud(7, 3000, 3000, 12, 1.0)
    assert recall_of(spark, loose, exact(loose, 20, 10), ratio=0.0) < 0.9


def test_repeated_rows_leave_room_for_k_others(spark):
    rows = cloud(5, 400, 8, 12, 1.0)
    rows += [(rows[i][0], rows[i][1]) for i in range(1, 6) for _ in range(150)]
    recall_of(spark, rows, exact(rows, 20, 10), ratio=0.0)


def test_the_order_of_rows_does_not_matter(spark):
    rows = [(0, [0.0, 1.0]), (0, [3.0, 3.0]), (7, [0.0, 3.0]), (8, [5.0, 5.0]), (8, [0.0, 9.0]), (None, [0.0, 1.0])]
    both = [[tuple(r) for r in nearest(vectors(spark, x)).orderBy("rank").collect()] for x in (rows, rows[::-1])]
    assert both[0] == both[1] == [(0, 1, 7, 2.0), (0, 2, 8, pytest.approx(41**0.5))]


def test_all_candidates_if_there_are_fewer(spark):
    rows = [(0, [0.0, 1.0]), (100, [0.0, 2.0]), (7, [0.0, 3.0]), (8, [0.0, 3.0])]
    got = [tuple(r) for r in nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 1.0), (0, 2, 7, 2.0), (0, 3, 8, 2.0), (100, 1, 0, 1.0), (100, 2, 7, 1.0), (100, 3, 8, 1.0)]


def test_lists_are_balanced_and_all_reachable():
    points = np.vstack([np.random.default_rng(1).normal(size=(800, 6)), np.random.default_rng(2).normal(size=(800, 6)) * 0.01 + 5])
    middle = centroids(points, 40)
    home = ((points[:, None] - middle[None]) ** 2).sum(-1).argmin(1)
    assert np.bincount(home).max() <= 6 * len(points) / len(middle)
    graph = Graph(middle, np.bincount(home, minlength=len(middle)))
    assert set(graph.lists(points[0], 1e9)) == set(range(len(middle)))
    assert graph.mean_square(points[0]) == pytest.approx(((middle - points[0]) ** 2).sum(1).mean())
