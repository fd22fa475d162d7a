import itertools

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute, shingle_set, similar, spread

import __spark_entry__
from inkfield.llm.common import Written
from inkfield.llm.langid import identify, learn
from inkfield.llm.mixing import mix
from inkfield.llm.queries import QUERIES


def test_every_operator_has_a_query():
    registered = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in registered) == 1
    assert registered["pipeline"] is corpus_pipeline.run and QUERIES.items() <= registered.items()
    assert set(__spark_entry__.oracle_sql()) <= set(registered)


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = Written(stage(spark, docs, sf), name).read()
        out.append((name, docs))
    return dict(out)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_stages_keep_the_columns_of_documents(steps):
    for name in ("language", "lines", "near", "mixture"):
        assert steps[name].columns == steps["documents"].columns


def test_language_drops_the_rejected_only(steps):
    docs = steps["documents"]
    told = {r.doc_id: r.rejected for r in identify(docs, learn(docs)).collect()}
    assert rows(steps["language"]) == sorted(str(tuple(r)) for r in docs.collect() if not told[r.doc_id])
    assert steps["language"].count() >= 0.95 * docs.count()


def test_lines_against_brute_force(steps):
    before = {r.doc_id: r for r in steps["language"].collect()}
    want = brute([(k, r.text) for k, r in before.items()], 2, 16)
    after = {r.doc_id: r for r in steps["lines"].collect()}
    got = sorted(str((k, after[k].text if k in after else next(eval(w)[1] for w in want if eval(w)[0] == k))) for k in before)
    assert got == want
    assert all(not next(eval(w)[1] for w in want if eval(w)[0] == k).strip() for k in before.keys() - after.keys())
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[k].lang, before[k].source) for k, r in after.items())


def test_near_keeps_one_of_each_group(steps):
    docs = {r.doc_id: r for r in steps["lines"].collect()}
    sets = {k: shingle_set(r.text, 5) for k, r in docs.items()}
    classes = spread(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])])
    assert sorted(r.doc_id for r in steps["near"].collect()) == sorted(k for k in docs if classes[k] == k)


def test_mixture_and_packing_lose_nothing(steps):
    assert rows(steps["mixture"]) == rows(steps["near"])
    pieces = steps["packing"].collect()
    ids = {r.doc_id for r in steps["near"].collect()}
    assert {p.doc_id for p in pieces} == ids
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_of_messy_rows(spark, sf, messy):
    unique = messy.toDF(*[f"c{i}" for i in range(len(messy.columns))])
    docs = unique.withColumn("n", F.length("c1").cast("long")).toDF(*messy.columns, "n_chars")
    told = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Written(stage(spark, docs, sf), name).read()
        told[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = docs.select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("extra"))
    kept = [r for r in told["language"].collect()]
    before = [tuple(r) for r in messy.collect()]
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept) and {(r.doc_id, r.text) for r in kept} <= {x[:2] for x in before}
    assert {r.doc_id for r in told["lines"].collect()} <= {r.doc_id for r in kept}
    near = told["near"].collect()
    assert sorted(map(str, told["mixture"].collect())) == sorted(map(str, near))
    sets = [shingle_set(r.text, corpus_pipeline.WORDS) for r in near]
    assert not any(similar(a, b) for (a, x), (b, y) in itertools.combinations(zip(sets, near, strict=True), 2) if (x.doc_id, x.text) != (y.doc_id, y.text))
    assert sum(p.length for p in told["packing"].collect() if p.start == 0) and {p.doc_id for p in told["packing"].collect()} == {r.doc_id for r in near}


def test_stages_of_no_rows(spark, sf, nothing):
    docs = nothing.withColumn("n_chars", F.lit(1).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_sequences_follow_the_mixture(spark, sf, tmp_path):
    docs = [(i, f"word{i} " * (300 if i >= 300 else 3), "en", "b" if i >= 100 else "a", 1) for i in range(900)]
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "false")
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(f"{tmp_path}/docs")
        mixed = Written(corpus_pipeline.mixture(spark, spark.read.parquet(f"{tmp_path}/docs"), sf), "mixed")
        pieces = corpus_pipeline.packing(spark, mixed.read(), sf).collect()
        order = sorted(mix(mixed.read()).collect(), key=lambda r: (r.phase, r.cycle, r.slot, r.place))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    at = {r.doc_id: i for i, r in enumerate(order)}
    tasks = {}
    for p in pieces:
        tasks.setdefault(p.sequence_id >> 32, []).append(at[p.doc_id])
    spans = [(min(v), max(v)) for _, v in sorted(tasks.items())]
    assert len(spans) > 2 and sum(len(set(v)) for v in tasks.values()) == len(docs)
    assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
