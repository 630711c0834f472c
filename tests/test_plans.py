"""Plan shape: no cartesian products, filters and columns pushed to the scan."""

import contextlib
import io

import pytest

PLAN_SAMPLE = [
    "flagship_region_share",
    "ft15_top_n",
    "ft69_yr_condition",
    "fx05_combined_filters",
    "lod01_table_wide",
    "lod02_fixed",
    "lod04_exclude",
    "g06_share_of_total",
    "j13_cardinality",
    "t01_top_n_per_group",
    "so06_distinct_on_key",
    "w15_total_share",
]


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", PLAN_SAMPLE)
def test_no_cartesian_product(spark, sf_small, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, sf_small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_flagship_pushdown_and_pruning(spark, sf_small):
    import __spark_entry__ as entry

    text = plan(entry.queries()["flagship_region_share"](spark, sf_small))
    scans = [blk for blk in text.split("\n\n") if "lineitem.parquet" in blk]
    assert any("GreaterThanOrEqual(l_quantity,5.0)" in b for b in scans)
    for b in scans:  # only the needed columns are read
        schema = [ln for ln in b.splitlines() if ln.startswith("ReadSchema")][0]
        assert "l_tax" not in schema and "l_shipdate" not in schema


def test_eager_aggregation_below_joins(spark, sf_small):
    import __spark_entry__ as entry

    text = plan(entry.queries()["w05_running_sum"](spark, sf_small), "simple")
    assert "HashAggregate(keys=[l_orderkey" in text  # lineitem reduced per order before the star joins
