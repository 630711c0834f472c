"""Table calculations addressed over all orders: no window runs in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import tablecalc as tc
from lodestar.operators import tablewide as tw
from lodestar.plans.registry import add
from lodestar.sources.tables import Tables

_ORDERS_SQL = "SELECT o_orderkey, o_orderdate, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"


def _orders(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", "o_orderpriority", cents)


def _add(name: str, build, exprs: dict[str, str]) -> None:
    cols = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    add(name, lambda spark, sf_dir: build(_orders(spark, sf_dir)).select("o_orderkey", *exprs), f"SELECT o_orderkey, {cols} FROM ({_ORDERS_SQL})")


_BY_DATE = "OVER (ORDER BY o_orderdate, o_orderkey)"
_ALL = "OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

# W01 to W04: five priorities hold all orders, so each tie goes over many ranges
for _name, _by in (("w01_table_wide_ranks", "o_orderdate"), ("w01_table_wide_ranks_of_few_keys", "o_orderpriority")):
    _add(
        _name,
        lambda o, _by=_by: tw.with_columns(o, {"rk": tw.rank(), "dense": tw.rank_dense(), "modified": tw.rank_modified(), "uniq": tw.rank_unique()}, [_by], ["o_orderkey"], descending=True),
        {
            "rk": f"rank() OVER (ORDER BY {_by} DESC)",
            "dense": f"dense_rank() OVER (ORDER BY {_by} DESC)",
            "modified": f"count(*) OVER (ORDER BY {_by} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "uniq": f"row_number() OVER (ORDER BY {_by} DESC, o_orderkey)",
        },
    )

# W05 to W09
_add(
    "w05_table_wide_running",
    lambda o: tw.with_columns(
        o,
        {"s": tw.running_sum("cents"), "a": tw.running_avg("cents"), "c": tw.running_count("cents"), "hi": tw.running_max("cents"), "lo": tw.running_min("cents")},
        ["o_orderdate"],
        ["o_orderkey"],
    ).withColumn("a", F.round("a", 4)),
    {
        "s": f"CAST(sum(cents) {_BY_DATE} AS BIGINT)",
        "a": f"round(CAST(sum(cents) {_BY_DATE} AS DOUBLE) / count(cents) {_BY_DATE}, 4)",
        "c": f"count(cents) {_BY_DATE}",
        "hi": f"max(cents) {_BY_DATE}",
        "lo": f"min(cents) {_BY_DATE}",
    },
)

# W11 to W15
_add(
    "w11_table_wide_positions",
    lambda o: tw.with_columns(o, {"f": tw.first(), "l": tw.last(), "i": tw.index(), "n": tw.size(), "t": tw.total("cents")}, ["o_orderdate"], ["o_orderkey"]),
    {
        "f": f"1 - row_number() {_BY_DATE}",
        "l": f"count(*) {_ALL} - row_number() {_BY_DATE}",
        "i": f"row_number() {_BY_DATE}",
        "n": f"count(*) {_ALL}",
        "t": f"CAST(sum(cents) {_ALL} AS BIGINT)",
    },
)

# W10, W17 to W21
_FRAME = "OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND 2 FOLLOWING)"
_add(
    "w17_table_wide_frames",
    lambda o: tw.with_frames(
        o,
        {
            "a": lambda w: F.round(tc.window_avg("cents", w, -6, 2), 4),
            "s": lambda w: tc.window_sum("cents", w, -6, 2),
            "lo": lambda w: tc.window_min("cents", w, -6, 2),
            "hi": lambda w: tc.window_max("cents", w, -6, 2),
            "c": lambda w: tc.window_count("cents", w, -6, 2),
            "prev": lambda w: tc.lookup("cents", -1, w),
            "next2": lambda w: tc.lookup("cents", 2, w),
        },
        -6,
        2,
        ["o_orderdate"],
        ["o_orderkey"],
    ),
    {
        "a": f"round(avg(cents) {_FRAME}, 4)",
        "s": f"CAST(sum(cents) {_FRAME} AS BIGINT)",
        "lo": f"min(cents) {_FRAME}",
        "hi": f"max(cents) {_FRAME}",
        "c": f"count(cents) {_FRAME}",
        "prev": f"lag(cents, 1) {_BY_DATE}",
        "next2": f"lead(cents, 2) {_BY_DATE}",
    },
)

# W22, W23 over wide frames: of the whole table, and of few large partitions
_WIDE = "ROWS BETWEEN 800 PRECEDING AND 200 FOLLOWING"
_add(
    "w22_table_wide_median",
    lambda o: tw.with_percentile(o, "v", "cents", 0.5, -800, 200, ["o_orderdate"], ["o_orderkey"]),
    {"v": f"median(cents) OVER (ORDER BY o_orderdate, o_orderkey {_WIDE})"},
)
_add(
    "w23_wide_frame_percentile",
    lambda o: tc.window_percentile_wide(o, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "cents", 0.9, -800, 200, "p").withColumn("v", F.round("p", 2)),
    {"v": f"round(quantile_cont(cents, 0.9) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey {_WIDE}), 2)"},
)
