"""Aggregation functions (A01…A17) and grouping operators (G-01…G-09, SO, T).

All aggregates are built-in, so ``groupBy().agg()`` plans as a partial
(map-side) + final hash aggregate: a hot key costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ A01 … A17
def sum_(x):
    return F.sum(_c(x))


def avg(x):
    return F.avg(_c(x))


def min_(x):
    return F.min(_c(x))


def max_(x):
    return F.max(_c(x))


def count(x):
    return F.count(_c(x))


def countd(x, approximate: bool = False, rsd: float = 0.01):
    """A06 exact distinct count; ``approximate`` uses HyperLogLog++ instead."""
    return F.approx_count_distinct(_c(x), rsd) if approximate else F.count_distinct(_c(x))


def median(x, approximate: bool = False, accuracy: int = 10000):
    """A07 exact (interpolated) median; the exact aggregate keeps one buffer of
    distinct values per group, so for very hot groups ``approximate`` switches
    to the mergeable ``percentile_approx`` sketch."""
    return F.percentile_approx(_c(x), 0.5, accuracy) if approximate else F.median(_c(x))


def stdev(x):
    return F.stddev_samp(_c(x))  # A08


def stdevp(x):
    return F.stddev_pop(_c(x))


def var(x):
    return F.var_samp(_c(x))  # A09


def varp(x):
    return F.var_pop(_c(x))  # A10


def percentile(x, p: float, approximate: bool = False, accuracy: int = 10000):
    """A11 continuous, interpolated percentile (``approximate``: sketch)."""
    return F.percentile_approx(_c(x), p, accuracy) if approximate else F.percentile(_c(x), F.lit(p))


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, ranges: int = 256) -> DataFrame:
    """A07 / A11 keys + ``value``: the continuous percentile of each group, exact at any group size.

    A mergeable sketch proposes split points a group; counts of the ranges between
    them (exact, partial aggregates) say in which range the wanted ranks lie, and
    only that range's distinct values are ordered: about one in ``ranges`` of a
    group.  NULL keys are groups, NULL values are left out, a group of NULLs has NULL.
    """
    v = F.col(value)
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    groups = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.percentile_approx(v, steps, 4 * ranges).alias("_splits"))
    rank = (F.col("_n") - 1) * F.lit(float(p))
    groups = groups.withColumns({"_lo": F.floor(rank), "_hi": F.ceil(rank), "_part": rank - F.floor(rank)})

    def on(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
        other = b.select(*[F.col(k).alias(f"_r_{k}") for k in names], *[c for c in b.columns if c not in names])
        return a.join(other, reduce(lambda x, y: x & y, [a[k].eqNullSafe(other[f"_r_{k}"]) for k in names]), how).drop(*[f"_r_{k}" for k in names])

    counts = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = on(counts, groups.select(*keys, "_splits", "_lo", "_hi"), keys)
    ranged = ranged.withColumn("_range", F.size(F.filter("_splits", lambda s: s < F.col("_v")))).drop("_splits")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_start", before)
    near = on(ranged, starts, [*keys, "_range"]).filter("_start <= _hi AND _start + _s > _lo")  # the ranges that hold a wanted rank
    within = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    at = lambda r: F.max(F.when((F.col("_from") <= F.col(r)) & (F.col("_from") + F.col("_c") > F.col(r)), F.col("_v").cast("double")))
    ends = placed.groupBy(*keys).agg(at("_lo").alias("_a"), at("_hi").alias("_b"))
    out = on(groups.select(*keys, "_part"), ends, keys, "left")
    return out.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("value"))


def attr(x):
    """A12 the value when it is the same on every row of the group, else ``*``."""
    x = _c(x)
    return F.when(F.min(x) == F.max(x), F.min(x).cast("string")).otherwise(F.lit("*"))


def corr(x, y):
    return F.corr(_c(x), _c(y))  # A13


def covar(x, y):
    return F.covar_samp(_c(x), _c(y))  # A14


def covarp(x, y):
    return F.covar_pop(_c(x), _c(y))  # A15


def count_if(cond, x=None):
    """A16 count rows (or non-null ``x``) where ``cond`` holds."""
    return F.count(F.when(_c(cond), _c(x) if x is not None else F.lit(1)))


def unique_count_if(cond, x):
    """A17 distinct ``x`` where ``cond`` holds."""
    return F.count_distinct(F.when(_c(cond), _c(x)))


# ---------------------------------------------------------------------- G rows
def dedupe(df: DataFrame, cols=None) -> DataFrame:
    """G-01 ``GROUP BY 1..n`` without aggregates."""
    return (df.select(*cols) if cols else df).dropDuplicates()


def having(df: DataFrame, keys, aggs: dict[str, Column], cond: Column) -> DataFrame:
    """G-02 groups passing an aggregate condition."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]).filter(cond)


_MEASURE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def default_aggregation(dtype: T.DataType) -> str:
    """G-03: measure (real/integer) -> SUM, dimension (string/date/bool/...) -> COUNT."""
    return "SUM" if isinstance(dtype, _MEASURE_TYPES) else "COUNT"


def auto_agg(df: DataFrame, dims, exclude=()) -> DataFrame:
    """G-03 aggregate every non-dimension column by its default aggregation."""
    aggs = []
    for f in df.schema.fields:
        if f.name in dims or f.name in exclude:
            continue
        if default_aggregation(f.dataType) == "SUM":
            aggs.append(F.sum(f.name).alias(f"sum_{f.name}"))
        else:
            aggs.append(F.count(f.name).alias(f"count_{f.name}"))
    return df.groupBy(*dims).agg(*aggs)


def nested(df: DataFrame, key, fields, sort_by=None) -> DataFrame:
    """G-04 rows -> one nested list per key (sorted for determinism).

    For keys whose groups are bounded by construction (columns per table,
    tables per model); never use it to gather an unbounded fact group."""
    items = F.struct(*([_c(sort_by)] if sort_by else []), *[_c(f) for f in fields])
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(F.sort_array(F.collect_list(items)).alias("items"))


def group_unique_count(df: DataFrame, x: str, key: str, name: str) -> DataFrame:
    """G-05 ``group_unique_count(x, key)`` attached to every row."""
    g = df.groupBy(key).agg(F.count_distinct(x).alias(name))
    return df.join(g, key, "left")


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as scalar
    subqueries: each is computed once and applied as a value in the
    projection (no join, no cartesian product, no single-task window)."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """G-06 value / grand total; the total is a one-row aggregate (broadcast)."""
    tot = df.agg(F.sum(value).alias("_total"))
    return attach_one_row(df, tot).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def first_by(df: DataFrame, keys, value: str, order: str, name: str | None = None) -> DataFrame:
    """G-09 first value per group by a position column (``min_by``, partial-aggregated)."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(name or value))


def distinct_on(df: DataFrame, keys, order: str) -> DataFrame:
    """SO-06 keep one row per key: the one with the smallest ``order`` value.

    ``min_by`` over a struct of the other columns aggregates map-side, so a
    key holding a third of the rows is reduced per task before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return g.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def top_n(df: DataFrame, keys, measure: Column, n: int, bottom: bool = False, name: str = "measure") -> DataFrame:
    """T-01/T-02: groups ranked by a measure, ties by key ascending."""
    agg = df.groupBy(*keys).agg(measure.alias(name))
    order = F.col(name).asc_nulls_last() if bottom else F.col(name).desc_nulls_last()
    return agg.orderBy(order, *[F.col(k).asc_nulls_first() for k in keys]).limit(n)


def top_n_per_group(df: DataFrame, group, order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """Top-k rows per group, exact and skew-safe.

    Phase 1 ranks inside (group, salt) slices — a hot group is spread over
    ``salts`` tasks — and keeps each slice's best ``n``; phase 2 ranks the at
    most ``salts * n`` survivors per group.  The top ``n`` of the union of the
    slices' top ``n`` is the top ``n`` of the group, so no row is dropped
    that belongs in the result.  ``order`` must end in a unique key."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    cand = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n).drop("_rn")


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), dfs).distinct()  # SO-01


def union_all_by_name(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)  # SO-02


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)  # SO-03/SO-04 (EXCEPT DISTINCT)


# ------------------------------------------- distinct counts at several grains
#: How the distinct values of a group are kept (A06, A17): ``bitmap`` exact, for whole numbers that lie
#: close together (4 KB for 32,768 neighbours); ``values`` exact, for any type (a row a distinct value);
#: ``sketch`` approximate (HyperLogLog, fixed size).
DISTINCT_FORMS = ("bitmap", "values", "sketch")


def distinct_state(df: DataFrame, dims: list[str], x, form: str = "values", cond: Column | None = None, lg_k: int = 14) -> DataFrame:
    """The distinct ``x`` of each group at the finest grain, in a form that can be united upward.

    Columns: ``dims``, ``_part`` and ``_state``.  One pass over the rows, aggregated
    map-side.  ``cond`` keeps the rows where it holds (A17); nulls are left out, and a
    group without any value has a row with an empty state, so that it is counted as 0."""
    x = _c(x) if cond is None else F.when(cond, _c(x))
    rows = df.select(*dims, x.alias("_x"))
    if form == "bitmap":
        n = F.col("_x").cast("long")
        placed = rows.select(*dims, F.bitmap_bucket_number(n).alias("_part"), F.bitmap_bit_position(n).alias("_x"))
        return placed.groupBy(*dims, "_part").agg(F.bitmap_construct_agg("_x").alias("_state"))
    if form == "values":
        return rows.select(*dims, F.col("_x").alias("_part")).distinct().withColumn("_state", F.col("_part").isNotNull().cast("long"))
    if form == "sketch":
        return rows.groupBy(*dims).agg(F.lit(0).alias("_part"), F.hll_sketch_agg("_x", F.lit(lg_k)).alias("_state"))
    raise ValueError(f"form must be one of {DISTINCT_FORMS}, not {form!r}")


_UNITE = {"bitmap": F.bitmap_or_agg, "values": F.max, "sketch": lambda c: F.hll_union_agg(c)}


def merge_distinct(states: list[DataFrame], dims: list[str], form: str = "values") -> DataFrame:
    """States of several tables or loads (``distinct_state``) as one: rows that were counted are not read again."""
    return union_all_by_name(*states).groupBy(*dims, "_part").agg(_UNITE[form]("_state").alias("_state"))


def distinct_counts(state: DataFrame, grains: list[list[str]], form: str = "values", name: str = "n") -> DataFrame:
    """The distinct count of each group of each grain: ``_grain`` (its place in ``grains``), the
    dimensions (null where a grain leaves one out) and ``name``.

    Every grain comes from the fine states, united, so the rows themselves are read once
    whatever the number of grains; what is repeated for a grain is a state, not a row.
    A null dimension value is a group; a grain without dimensions is one row (none for an empty table)."""
    dims = list(dict.fromkeys(d for g in grains for d in g))
    types = {f.name: f.dataType for f in state.schema.fields}
    forms = [F.struct(F.lit(i).alias("_grain"), *[(F.col(d) if d in g else F.lit(None).cast(types[d])).alias(d) for d in dims]) for i, g in enumerate(grains)]
    if form == "values":
        # as many states as values, and each is taken once a grain: they cross the network once, by value, to as many
        # tasks as the session has for a shuffle (not to as few as their bytes ask for), and the grains unite them there
        state = state.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part")
    at = state.select(F.explode(F.array(*forms)).alias("_g"), "_part", "_state").select("_g.*", "_part", "_state")
    keys = ["_grain", *dims]
    united = at.groupBy(*keys, "_part").agg(_UNITE[form]("_state").alias("_state"))
    size = {"bitmap": F.bitmap_count("_state"), "values": F.col("_state"), "sketch": F.hll_sketch_estimate("_state")}[form]
    return united.groupBy(*keys).agg(F.sum(size).alias(name))
