"""Loops over lines and balls stay below the 8000 bytes of code up to which the JVM compiles a method."""

import pytest

from crease import registry_lists
from crease.sources import pages


@pytest.mark.parametrize("name", ["scorecard_batting_lines", "scorecard_bowling_lines"])
def test_loops_are_compiled(spark, sf_dir, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry_lists.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["scorecard_batting_lines", "scorecard_bowling_lines", "scorecard_innings"])
def test_pages_are_parsed_once(spark, sf_dir, name):
    plan = registry_lists.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


@pytest.mark.parametrize("name", ["scorecard_batting_lines", "scorecard_bowling_lines"])
def test_a_list_of_lines_is_taken_in_one_look(spark, sf_dir, name):
    """Six looks find the innings and their lines, two their number; what is left are fields that may be a text or an object, and flags."""
    plan = registry_lists.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") <= 3 + 2 + 3 + (6 if "batting" in name else 0)


def test_lines_of_odd_shapes(spark):
    """Fields that are null, numbers, lists or objects where others are expected, lines that are no objects, and lists that are none."""
    lines = '[{"player":{"name":" A ","objectId":7},"conceded":null,"runs":"9","overs":4.2},{"player":"x","bowler":{"longName":{"a":1},"objectId":"8"},"wickets":[1]},5,null,{"overs":{"o":1}}]'
    data = [(1, f'{{"innings":[{{"inningBowlers":3,"bowlers":{lines},"batting":[{{"dismissalText":"b X","isOut":true}},{{"dismissalText":{{"short":"lbw"}},"isOut":"true","strikeRate":5}}]}}]}}')]
    rows = spark.createDataFrame(data, "page_id long, data string")
    bowl = pages.bowling_lines(rows, "").orderBy("bowling_pos").select("bowling_pos", "source_id", "name", "wickets", "runs", "overs").collect()
    assert [tuple(r) for r in bowl] == [
        (1, 7, "A", 0, 9, "4.2"), (2, 8, '{"a":1}', 0, 0, None), (3, None, None, 0, 0, None), (4, None, None, 0, 0, None), (5, None, None, 0, 0, '{"o":1}')
    ]
    bat = pages.batting_lines(rows, "").orderBy("batting_pos").select("out", "dismissal", "strike_rate").collect()
    assert [tuple(r) for r in bat] == [(True, "BOWLED", None), (None, "LBW", 5.0)]


@pytest.mark.parametrize("name", ["scorecard_batting_lines", "scorecard_bowling_lines", "scorecard_innings"])
def test_no_innings_is_built_again_and_no_line_interpreted(spark, sf_dir, name):
    """An innings taken out as a parsed value is copied whole; a function over a list of lines is never compiled."""
    plan = registry_lists.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") == 3 + (6 if "batting" in name else 0)
    assert "ArrayType(VariantType" not in plan and "lambdafunction" not in plan


def test_lines_of_no_order(spark, tmp_path):
    """Lines without an order are a page too, as in the SQL; lines that lack numbers stay."""
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    rows = [(None, 5, 1, 2, 9.0, 1.0), (None, 4, 1, 1, 8.0, 1.0), (3, 6, 1, 2, None, 1.0), (3, 7, 1, 1, 2.0, 1.0), (2, None, 1, 1, 3.0, 1.0)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry_lists.queries()["scorecard_bowling_lines"](spark, str(tmp_path)).select("page_id", "innings_no", "bowling_pos", "source_id", "wickets", "runs", "overs")
    assert sorted(map(tuple, found.collect()), key=str) == [
        (2, 1, 1, None, 1, 5, "1.0"), (3, 7, 1, 7, 1, 2, "1.0"), (3, 7, 2, 6, 2, 0, "2.0"), (None, 1, 1, 4, 1, 10, "1.0"), (None, 1, 2, 5, 2, 11, "2.0")
    ]
