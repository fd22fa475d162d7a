import pytest
from oracle import connect, differences

from inkfield.plans.certificates import AT, VARIANTS
from inkfield.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, name, QUERIES, ORACLES) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_no_query_gives_one_constant_answer(sf, name):
    """Every column that is no key takes two values at least, so that the comparison says something."""
    con = connect(sf)
    names = [d[0] for d in con.execute(f"SELECT * FROM ({ORACLES[name]}) LIMIT 0").description]
    counts = con.execute("SELECT count(*), " + ", ".join(f"count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END" for c in names) + f" FROM ({ORACLES[name]})").fetchone()
    assert counts[0] >= 2
    assert not {c: n for c, n in zip(names, counts[1:], strict=True) if n < 2 and c not in CONSTANT.get(name, ())}


# What cannot vary: the number of parts is that of the only kind of split number.
CONSTANT = {"digit_islands": ("n_parts", "x1", "x2")}


def test_joins_stay_within_documents(spark, sf):
    for name in ("label_value_best", "stacked_continuation", "belongs_to_other_label", "available_values", "column_walk"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scans_read_only_what_they_need(spark, sf):
    plan = QUERIES["tax_number_check"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_activity_split_keeps_every_part(spark, tmp_path):
    keys = (899_999, 900_000, 989_997, 990_000, 990_001, 990_002)
    spark.createDataFrame([(k, "BRASS") for k in keys], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: (r.code, r.description) for r in QUERIES["activity_split"](spark, str(tmp_path)).collect()}
    six = {k: (str(10_000 + k), "BRASS") if k % 3 != 2 and k < 990_000 else (None, None) for k in keys}
    assert got == six


def test_merged_numbers_have_their_confidence_checked(spark, sf):
    got = {int(r.doc_id): r.confidence for r in QUERIES["number_confidence"](spark, sf).collect()}
    assert got.keys() == {int(r.doc_id) for r in QUERIES["flagship_roundtrip"](spark, sf).select("doc_id").collect()}
    merged = [c for k, c in got.items() if k % len(VARIANTS) == AT["number over two blocks"]]
    assert len(merged) > 3 and set(merged) == {0.8955}


def test_labels_are_matched_once(spark, sf):
    found = QUERIES["label_value_best"](spark, sf)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("levenshtein") == QUERIES["label_best_alias"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("levenshtein")
