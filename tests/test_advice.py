"""Advice on assets: what meets what, and that nothing wide is moved for it."""

import pytest

from quantalog.operators import advice
from quantalog.plans import advice as plans
from quantalog.sources import estate

SF = "/root/testdata/sf0.001"


@pytest.fixture
def by_shuffle(spark):
    """No join is broadcast unless the code says so, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_once(spark, by_shuffle):
    """customers meet orders before lines do, so that lines aren't dealt again by their customer."""
    joins = [x for x in plan(estate.findings(spark, SF)).splitlines() if "SortMergeJoin" in x]
    assert ["l_orderkey" in x for x in joins] == [True, False]


def test_steps_go_to_the_assets(spark, by_shuffle, monkeypatch):
    """few steps are sent to all tasks, many are joined by a shuffle; either way the rows are the same."""
    sent = plans.recommendations(spark, "/root/testdata/sf0.01")
    assert "BroadcastHashJoin [system" in plan(sent)
    rows = sorted(sent.collect(), key=str)
    monkeypatch.setattr(advice, "BROADCAST_ROWS", -1)
    dealt = plans.recommendations(spark, "/root/testdata/sf0.01")
    assert "BroadcastHashJoin [system" not in plan(dealt)
    assert sorted(dealt.collect(), key=str) == rows and any(r.first_steps for r in rows)


def test_clauses_without_steps(spark, by_shuffle):
    """no steps are gathered and joined for clauses, which don't tell them."""
    assert "steps" not in plan(plans.procurement_clauses(spark, SF))


def test_tallies_without_steps(spark, by_shuffle):
    """nor for tallies."""
    assert "steps" not in plan(plans.recommendation_tallies(spark, SF))


def test_uncovered(spark, monkeypatch):
    """any recommendations count, and the rows are the same whether hashes are sent or ids are joined."""
    assets = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), (None, True), ("b", True)], "id string, quantum_vulnerable boolean")
    given = spark.createDataFrame([("a",), ("a",), ("c",), ("x",), (None,)], "id string")
    for most in (10, 0):
        monkeypatch.setattr(advice, "HASHES_SENT", most)
        assert sorted(str(r.id) for r in advice.uncovered(assets, given).collect()) == ["None", "b", "b", "d"]
