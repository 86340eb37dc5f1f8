"""Physical plans: what is read, joined and compiled."""

import re

import pytest

from strikeline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def static(spark):
    """Without runtime re-planning, so that the whole plan is known before it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def physical(df):
    return df._jdf.queryExecution().executedPlan()


def method_sizes(spark, df):
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(physical(df))
    return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]


@pytest.mark.parametrize("name", ["greeks", "option_score", "iv_state_level", "expected_move", "theta_below_p25", "table_sort_page", "ticker_summary", "export_conform"])
def test_methods_are_small_enough_to_be_compiled(static, name):
    sizes = method_sizes(static, QUERIES[name](static, SF))
    assert sizes and max(sizes) < 8000


def test_the_whole_plan_reads_and_joins_little(static):
    plan = physical(QUERIES["export_conform"](static, SF)).toString()
    read = re.findall(r"Location: [^\[]*\[([^\],]*)", plan)
    assert sum("lineitem" in x for x in read) <= 4
    assert len(re.findall("BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|NestedLoopJoin", plan)) <= 8


def test_row_columns_take_few_selects(static):
    from strikeline.plans import enrich, queries, tables

    rows = enrich.enrich_rows(tables.chain(static, SF), queries.PARAMS, settled=False)
    logical = rows._jdf.queryExecution().analyzed().toString()
    assert logical.count("Project [") <= 15  # of these, three make the chain
    assert logical.count("Repartition 1073741824") <= 10
    assert max(method_sizes(static, rows)) < 8000


def test_rows_are_not_shuffled_for_small_statistics(static):
    """Positions and statistics are stored first, so their size is known, and they are sent to the rows."""
    plan = physical(QUERIES["export_conform"](static, SF)).toString()
    assert plan.count("BroadcastHashJoin") == 5 and "SortMergeJoin" not in plan  # part, positions, and three sets of keys


def test_statistics_join_narrow_rows(static):
    """Joins of more than a hundred columns are in no generated method, and took most of the export's time."""
    plan = physical(QUERIES["export_conform"](static, SF)).toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert len(joins) == 5 and all(re.search(r"\*\(\d+\) BroadcastHashJoin", line) for line in joins)


def test_bucketed_snapshots_are_grouped_without_an_exchange(static):
    from strikeline.operators import export
    from strikeline.plans import tables

    export.write_bucketed(tables.chain(static, SF), "bucketed_chain", 4)
    try:
        plan = physical(static.table("bucketed_chain").groupBy("underlying_symbol").count()).toString()
        assert "Exchange" not in plan and "FileScan" in plan
        chain = static.table("bucketed_chain")
        joined = chain.join(chain.groupBy("underlying_symbol").count().hint("shuffle_merge"), "underlying_symbol")
        assert "Exchange" not in physical(joined).toString()
    finally:
        static.sql("DROP TABLE bucketed_chain")


def test_filters_read_the_chain_once(static):
    plan = physical(QUERIES["filter_with_bypass"](static, SF)).toString()
    # the chain, and the positions made of a part of it
    assert sum("lineitem" in x for x in re.findall(r"Location: [^\[]*\[([^\],]*)", plan)) == 2


def test_filters_reach_the_scan(static):
    plan = physical(QUERIES["chain_slice"](static, SF)).toString()
    assert "PushedFilters: [" in plan and "ReadSchema" in plan


@pytest.mark.parametrize("name", ["top_profitable", "top_moderate", "top_conviction", "highlights"])
def test_rankings_hash_groups_and_are_compiled(static, name):
    """Rows are not sorted by group, which would spill them, and the screen is one compiled method."""
    df = QUERIES[name](static, SF)
    plan = physical(df).toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
    assert max(method_sizes(static, df)) < 8000


def test_csv_exports_are_compressed(spark, tmp_path):
    from strikeline.operators import export
    from strikeline.plans import tables

    export.write_csv(tables.chain(spark, SF), str(tmp_path / "out.csv"))
    files = list((tmp_path / "out.csv").glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
