"""Places and pages over ranges of tasks, against plain sorting; the contract table against its rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from crease import oracles, registry
from crease.operators import paging
from crease.sources import made, shape


@pytest.fixture
def rows(spark):
    return spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id").repartition(5)


def plain(rows):
    return sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[1]))


def order():
    return [F.desc("x"), F.asc("id")]


def test_places(spark, rows):
    found = paging.placed(rows, order()).orderBy("place").collect()
    assert [r.place for r in found] == list(range(1, 1001)) and [(r.x, r.id) for r in found] == plain(rows)
    assert paging.placed(rows.limit(0), order()).count() == 0


@pytest.mark.parametrize(("page", "first", "n"), [(1, 0, 30), (0, 0, 30), (4, 90, 30), (34, 990, 10), (35, 990, 10), (99, 990, 10)])
def test_pages(spark, rows, tmp_path, page, first, n):
    expected = plain(rows)[first : first + n]
    assert [tuple(r) for r in paging.paged(rows, order(), page, 30).collect()] == expected
    paging.write_pages(rows, order(), 30, str(tmp_path / "pages"))
    written = spark.read.parquet(str(tmp_path / "pages"))
    assert [(r.x, r.id) for r in paging.read_page(written, page).collect()] == expected


def test_pages_of_little_and_nothing(spark, rows, tmp_path):
    for few in (rows.limit(0), rows.filter("id = 7")):
        n = few.count()
        assert paging.paged(few, order(), 3, 10).count() == n
        paging.write_pages(few, order(), 10, str(tmp_path / f"p{n}"))
        assert paging.read_page(spark.read.parquet(str(tmp_path / f"p{n}")), 3).count() == n


def test_a_page_is_one_range(spark, tmp_path):
    """A late page of many is read from one file."""
    big = spark.range(200_000).select((F.col("id") % 977).alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paging.write_pages(big, order(), 10, str(tmp_path / "pages"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    page = paging.read_page(spark.read.parquet(str(tmp_path / "pages")), 15_000)
    assert page.count() == 10 and page.select(F.input_file_name()).distinct().count() == 1
    assert "PushedFilters: [IsNotNull(page)" in page._sc._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")


def test_every_rule_has_documents_that_break_it(spark, sf_dir):
    table = shape.rules()
    good, bad = shape.split_by_rules(made.odd_documents(spark, sf_dir, table), table)
    said = {r for row in bad.collect() for r in row.reasons}
    assert said == {r.reason for r in table if r.how != "maybe"} and len(said) == 20
    assert all(len(r.reasons) == 1 for r in bad.collect()) and good.count() > 0


def test_rules_of_bare_documents(spark):
    """Nothing in it but an id: what must be there is missing, all that may be absent is; several faults are all told."""
    columns = shape.schema(shape.rules())
    rows = spark.createDataFrame([("m", "{}"), ("", '{"info": {"toss": {"decision": "?"}, "teams": [null]}, "innings": []}'), ("n", '{"info": {}, "innings": [{}]}')], "id string, text string")
    docs = rows.select("id", F.from_json("text", columns).alias("d")).select(F.col("id").alias("match_id"), *[f"d.{c}" for c in ("meta", "info", "innings")])
    good, bad = shape.split_by_rules(docs)
    assert [r.match_id for r in good.collect()] == ["n"]
    assert {r.match_id: list(r.reasons) for r in bad.collect()} == {
        "m": ["info: missing", "innings: missing"],
        "": ["match_id: blank", "info.teams[]: missing", "info.toss.decision: not one of bat,field"],
    }


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 990, 1000])
def test_last_page(spark, rows, n):
    some = rows.filter(F.col("id") < n)
    expected = plain(some)[(n - 1) // 30 * 30 :] if n else []
    assert [tuple(r) for r in paging.last_page(some, order(), [F.asc("x"), F.desc("id")], 30).collect()] == expected


def test_team_matches_of_more_pages(spark, tmp_path):
    """A team with more than 99 pages of matches: the last one comes, as in the SQL."""
    duckdb.sql(f"COPY (SELECT i * 10 AS l_partkey FROM range(6000) t(i)) TO '{tmp_path}/lineitem.parquet'")
    got = registry.queries()["team_matches_page"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW l AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    con.sql("CREATE VIEW lineitem AS SELECT *, 1 AS l_orderkey, 1 AS l_linenumber, 1 AS l_suppkey, 1.0 AS l_quantity, 1.0 AS l_extendedprice, 'R' AS l_returnflag, NULL AS l_shipdate FROM l")
    assert [tuple(r) for r in got] == con.sql(oracles.SQL["team_matches_page"] + " ORDER BY rn").fetchall() and got
