import itertools
import random
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfield.llm import linkage
from inkfield.llm.linededup import SPACE, Layout, dedup_lines, item_of, keys_of, within
from inkfield.llm.linkage import components
from inkfield.llm.minhash import FINE, MATCHES, fine_bits, most_apart, near_duplicates


def spread(nodes, links):
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, n) for n in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).read().collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == spread(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).read().collect() == []


def shingle_set(text, words):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} - {()}


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def test_near_duplicates_of_families(spark):
    """A family of loose copies with chains, exact copies, and others, against all pairs."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(text)))
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        rows += [(2000 + 2 * i, " ".join(text)), (2001 + 2 * i, " ".join(text[:-1] + ["End"]))]
    sets = {k: shingle_set(t, 4) for k, t in rows}
    want = spread(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}


def test_no_method_that_pairs_pass_through_is_interpreted(spark, monkeypatch):
    """The JVM compiles no method over 8000 bytes; Spark falls back to smaller ones where its limit says so."""
    seen = []

    class Watched(linkage.Written):
        def __init__(self, df, what):
            stages = df._jdf.queryExecution().debug().codegenToSeq()
            longest = max([stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())], default=0)
            seen.append((what, longest, int(spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535"))))
            super().__init__(df, what)

    monkeypatch.setattr(linkage, "Written", Watched)
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() < 0.96 else str(rng.random()) for w in base)) for i in range(40)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are generated only once they run
    try:
        assert near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).count() == 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert any(longest > 8000 for _, longest, _ in seen)
    assert [x for x in seen if x[1] > 8000 and x[2] > 8000] == []


def test_no_link_between_documents_is_lost(spark):
    """All documents of a table against exact overlaps of their shingle sets."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text, 4) for r in rows.collect()}
    holders, overlap = defaultdict(list), Counter()
    for k, shingles in sets.items():
        for x in shingles:
            overlap.update((other, k) for other in holders[x])
            holders[x].append(k)
    links = [(a, b) for (a, b), n in overlap.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    want = spread(sets, links)
    got = near_duplicates(rows, words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), want[k]) for k in sets} and len(links) > 50


def test_few_pairs_at_the_threshold_are_denied():
    assert sum(comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(MATCHES)) < 1e-7
    differ = 0.2 * 15 / 16
    chance = lambda most: sum(comb(FINE, k) * differ**k * (1 - differ) ** (FINE - k) for k in range(most + 1, FINE + 1))
    assert chance(most_apart(80)) <= 1e-9 < chance(most_apart(80) - 1)


def test_fine_bits_agree_as_often_as_they_should(spark):
    rng = np.random.default_rng(4)
    common, own = rng.integers(0, 1 << 63, 800, np.uint64), rng.integers(0, 1 << 63, (2, 100), np.uint64)
    sets = spark.createDataFrame([(i, np.sort(np.concatenate((common, own[i]))).tobytes()) for i in range(2)], "item long, shingles binary")
    a, b = (np.array(r.bits, np.int64) for r in fine_bits(sets).orderBy("item").collect())
    planes = np.unpackbits((a ^ b).view(np.uint8)).reshape(4, -1)
    assert abs(planes.max(0).sum() - FINE * 0.2 * 15 / 16) < 60 and most_apart(80) > planes.max(0).sum()


def test_near_duplicates_of_messy_rows(messy, nothing):
    got = near_duplicates(messy, words=5).collect()
    rows = [(r[0], r[1]) for r in map(tuple, messy.collect())]
    assert len(got) == len(rows)
    nodes = dict(enumerate(rows))
    sets = {i: shingle_set(t, 5) for i, (_, t) in nodes.items()}
    classes = spread(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if similar(sets[a], sets[b])])
    want = []
    for i, (k, _) in nodes.items():
        ids = [nodes[j][0] for j in nodes if classes[j] == classes[i] and nodes[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else k
        want.append((k, len(sets[i]), least, k is not None and k == least))
    order = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=order) == sorted(want, key=order)
    assert near_duplicates(nothing).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=24), st.text("abé", max_size=24), st.integers(0, 6))
def test_banded_distance(a, b, edits):
    assert within(a, b, edits) == (distance(a, b) <= edits)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=6, max_size=40), st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abx-")), max_size=2))
def test_close_lines_share_a_key(line, changes):
    other = list(line)
    for at, c in changes:
        at %= len(other)
        if c == "-":
            del other[at]
        else:
            other[at : at + (c != "x")] = c
    other = "".join(other)
    layout = Layout(2)
    if distance(line, other) <= 2 and len(other) > 2:
        assert set(keys_of(line, layout)) & set(keys_of(other, layout))


def brute(rows, edits, least):
    """Kept text of each (id, text), by comparing all lines with each other."""
    places = {}
    for k, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(SPACE)
            if t is not None and len(line) >= least:
                places.setdefault(line, []).append(((k is None, k or 0, item_of(t), n), (k, t, n)))
    links = [(a, b) for a, b in itertools.combinations(places, 2) if abs(len(a) - len(b)) <= edits and within(a, b, edits)]
    classes, first = spread(places, links), {}
    for line, found in places.items():
        first[classes[line]] = min(first.get(classes[line], min(found)[0]), min(found)[0])
    gone = {own for line, found in places.items() for place, own in found if place != first[classes[line]]}
    return sorted(str((k, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, t, n) not in gone))) for k, t in rows)


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(5, 60))) for _ in range(60)]
    for line in list(lines):
        for _ in range(3):
            other = list(line)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice("abcXY")
            lines.append("".join(other))
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(("", " ", "\t")) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=8)
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == brute(rows, 2, 8)


def test_line_dedup_of_messy_rows(messy, nothing):
    rows = [(r[0], r[1]) for r in map(tuple, messy.collect())]
    got = dedup_lines(messy, least=4, keep=("lang", "source", "TEXT", "start")).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "TEXT", "start", "n_lines", "n_dropped"}
    assert sorted(str((r.doc_id, r[1])) for r in got) == brute(rows, 2, 4)
    assert dedup_lines(nothing).collect() == []
