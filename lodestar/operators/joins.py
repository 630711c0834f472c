"""Relationship-driven joins (J-01…J-16, P-01, MP-02).

A workbook declares relationships between tables; the star join walks the
(small, driver-side) edge list and builds one lazy join plan.  The physical
strategy is Catalyst's and AQE's: a side is broadcast only when its size is
known to be small (statistics under ``autoBroadcastJoinThreshold`` or a
runtime-measured shuffle stage), everything else is a sort-merge / shuffled
hash join on the relationship keys.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MP-02 fixed values: workbook join kind -> target join kind.
JOIN_TYPE_MAP = {"inner": "INNER", "left": "LEFT_OUTER", "right": "RIGHT_OUTER", "full": "OUTER"}

# Spark join-type names for the workbook kinds.
_SPARK_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}
_FLIP = {"inner": "inner", "left": "right", "right": "left", "full": "full"}


@dataclass(frozen=True)
class Relationship:
    """One edge: ``left`` JOIN ``right`` ON all key pairs (J-06 composite keys)."""

    left: str
    right: str
    keys: list = field(default_factory=list)  # [(left_col, right_col), ...]
    how: str = "inner"
    hint: str | None = None  # J-16: optional strategy hint for the right side
    compared: tuple = ()  # [(left_col, operator, right_col), ...], beside the keys


# Comparison operators of clauses (fixed values).
COMPARISONS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "<>": operator.ne, "!=": operator.ne}
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _condition(e: Relationship) -> Column:
    left, right = (lambda c, t=t: F.col(f"`{t}`.`{c}`") for t in (e.left, e.right))
    parts = [left(x) == right(y) for x, y in e.keys] + [COMPARISONS[op](left(x), right(y)) for x, op, y in e.compared]
    return reduce(lambda x, y: x & y, parts)


def join_order(edges: list[Relationship]) -> list[tuple[Relationship, bool]]:
    """J-05: start at the first edge, attach any edge touching a joined table,
    re-queue the others.  Returns (edge, flipped) in attach order; ``flipped``
    means the edge's left table is the one being attached."""
    if not edges:
        return []
    joined = {edges[0].left}
    queue = list(edges)
    ordered: list[tuple[Relationship, bool]] = []
    stalled = 0
    while queue:
        e = queue.pop(0)
        if e.left in joined and e.right in joined:
            ordered.append((e, False))  # extra condition between joined tables
            stalled = 0
        elif e.left in joined:
            ordered.append((e, False))
            joined.add(e.right)
            stalled = 0
        elif e.right in joined:
            ordered.append((e, True))
            joined.add(e.left)
            stalled = 0
        else:
            queue.append(e)
            stalled += 1
            if stalled > len(queue):
                raise ValueError(f"relationship {e.left}->{e.right} is not connected to {sorted(joined)}")
    return ordered


def star_join(frames: dict[str, DataFrame], edges: list[Relationship], keep_right_keys: bool = False) -> DataFrame:
    """Join all tables named in ``edges`` and project every column once.

    P-01: right-hand join keys are dropped (their values equal the left keys
    for inner joins).  Columns keep their names; a name used by two tables is
    prefixed with ``<table>__``.  Multiple edges between the same two tables are
    AND-ed into one condition (Q6).
    """
    if not edges:
        raise ValueError("no relationships")
    merged: dict[tuple[str, str], Relationship] = {}
    for e in edges:
        k = (e.left, e.right)
        if k in merged:
            old = merged[k]
            merged[k] = Relationship(old.left, old.right, list(old.keys) + list(e.keys), old.how, old.hint, (*old.compared, *e.compared))
        else:
            merged[k] = e
    order = join_order(list(merged.values()))
    first = order[0][0].left
    plan = frames[first].alias(first)
    attach_seq = [first]
    joined = {first}
    kept_keys: dict[tuple[str, str], list[tuple[str, str]]] = {}  # key column -> equal columns of outer-joined tables
    dropped: set[tuple[str, str]] = set()
    used: set[tuple[str, str]] = set()
    for e, flipped in order:
        if (e.left, e.right) in used:
            continue
        new = e.left if flipped else e.right
        # every edge between the new table and those joined so far belongs to this join's condition
        conds = [x for x in merged.values() if new in (x.left, x.right) and ({x.left, x.right} - {new}) <= joined]
        used |= {(x.left, x.right) for x in conds}
        side = frames[new].alias(new)
        if e.hint:
            side = side.hint(e.hint)
        how = _FLIP[e.how] if flipped else _SPARK_HOW[e.how]
        plan = plan.join(side, reduce(lambda x, y: x & y, [_condition(x) for x in conds]), how)
        joined.add(new)
        attach_seq.append(new)
        if not keep_right_keys:
            for x in conds:
                for lk, rk in x.keys:
                    own, other = ((x.left, lk), (x.right, rk)) if x.left == new else ((x.right, rk), (x.left, lk))
                    dropped.add(own)
                    if how in ("right", "full"):  # rows of the new table alone have the key on its side only
                        kept_keys.setdefault(other, []).append(own)
    names: dict[str, int] = {}
    for t in attach_seq:
        for c in frames[t].columns:
            if (t, c) not in dropped:
                names[c] = names.get(c, 0) + 1

    def value(t: str, c: str, seen: frozenset = frozenset()) -> list[Column]:
        """The column and, after outer joins, those equal to it."""
        more = [v for o in kept_keys.get((t, c), []) if o not in seen for v in value(*o, seen | {(t, c)})]
        return [F.col(f"`{t}`.`{c}`"), *more]

    cols = []
    for t in attach_seq:
        for c in frames[t].columns:
            if (t, c) in dropped:
                continue
            out = c if names[c] == 1 else f"{t}__{c}"
            parts = value(t, c)
            cols.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(out))
    return plan.select(*cols)


def equi_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """J-01…J-04: one join with workbook join kinds."""
    cond = reduce(lambda x, y: x & y, [left[a] == right[b] for a, b in keys])
    return left.join(right, cond, _SPARK_HOW.get(how, how))


def semi_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """J-09: keep rows with a match; never multiplies rows."""
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """J-10: rows without a match."""
    return df.join(keys, on, "left_anti")


def null_safe_join(df: DataFrame, lookup: DataFrame, pairs, how: str = "left") -> DataFrame:
    """J-12: NULL matches NULL on every key pair (``<=>``)."""
    cond = reduce(lambda x, y: x & y, [df[a].eqNullSafe(lookup[b]) for a, b in pairs])
    return df.join(lookup, cond, how)


def lookup_join(df: DataFrame, lookup: DataFrame, on, how: str = "left") -> DataFrame:
    """J-11: join a mapping table.  Mapping tables are fixed-size literals, so
    the broadcast is size-bounded by construction."""
    return df.join(F.broadcast(lookup), on, how)


def cardinality(left: DataFrame, right: DataFrame, left_keys, right_keys) -> DataFrame:
    """J-13 (re-aimed): measure the relationship cardinality from data.

    One row with ``left_max``/``right_max`` = the largest number of rows per
    key on each side and the label ONE_TO_ONE / ONE_TO_MANY / MANY_TO_ONE /
    MANY_TO_MANY.  Two partial aggregates, no join of the sides.  Rows with a
    NULL key match nothing and are not counted.
    """
    left, right = left.dropna(subset=list(left_keys)), right.dropna(subset=list(right_keys))
    lm = left.groupBy(*left_keys).count().agg(F.max("count").alias("left_max"))
    rm = right.groupBy(*right_keys).count().agg(F.max("count").alias("right_max"))
    from lodestar.operators.grouping import attach_one_row

    both = attach_one_row(lm, rm)  # one row each
    label = (
        F.when((F.col("left_max") <= 1) & (F.col("right_max") <= 1), "ONE_TO_ONE")
        .when(F.col("left_max") <= 1, "ONE_TO_MANY")
        .when(F.col("right_max") <= 1, "MANY_TO_ONE")
        .otherwise("MANY_TO_MANY")
    )
    return both.select(F.col("left_max").cast("bigint"), F.col("right_max").cast("bigint"), label.alias("cardinality"))


def parse_join_operands(col: Column) -> Column:
    """J-14: ``[a].[x]::[b].[y]`` -> struct(left_table, left_column, right_table, right_column)."""
    pat = r"^\[([^\]]*)\]\.\[([^\]]*)\]::\[([^\]]*)\]\.\[([^\]]*)\]$"
    return F.struct(
        F.regexp_extract(col, pat, 1).alias("left_table"),
        F.regexp_extract(col, pat, 2).alias("left_column"),
        F.regexp_extract(col, pat, 3).alias("right_table"),
        F.regexp_extract(col, pat, 4).alias("right_column"),
    )


_OPERAND = r"^\[([^\]]*)\]\.\[([^\]]*)\]$"


def clause_comparisons(nodes: Column) -> Column:
    """J-14 on trees: the comparisons of a clause (``extract.clause_nodes``) in document order, as an array of
    (op, left_table, left_column, right_table, right_column); an operand that is no ``[table].[column]`` is null."""
    compared = F.filter(nodes, lambda x: x["op"].isin(list(COMPARISONS)))

    def one(x):
        operands = F.filter(nodes, lambda y: y["parent"] == x["n"])
        part = lambda i, g: F.nullif(F.regexp_extract(F.try_element_at(operands, F.lit(i))["op"], _OPERAND, g), F.lit(""))
        return F.struct(x["op"].alias("op"), part(1, 1).alias("left_table"), part(1, 2).alias("left_column"), part(2, 1).alias("right_table"), part(2, 2).alias("right_column"))

    return F.transform(compared, one)


def clause_condition(nodes: list, column: Callable[[str, str], Column]) -> Column:
    """The condition that one clause's nodes (rows of n, op, parent) state: comparisons under AND, OR and NOT to any depth.

    ``column`` gives the Column of a table and a name.  A clause is a handful of
    nodes of metadata, so this runs on the driver.
    """
    below: dict = {}
    for x in nodes:
        below.setdefault(x["parent"], []).append(x)

    def value(x) -> Column:
        op, args = x["op"], [value(y) for y in below.get(x["n"], [])]
        if op.upper() in ("AND", "OR") and args:
            return reduce((lambda a, b: a & b) if op.upper() == "AND" else (lambda a, b: a | b), args)
        if op.upper() == "NOT" and len(args) == 1:
            return ~args[0]
        if op in COMPARISONS and len(args) == 2:
            return COMPARISONS[op](*args)
        named = re.match(_OPERAND, op)
        if args or not named:
            raise ValueError(f"clause with {op} of {len(args)} operands")
        return column(*named.groups())

    roots = below.get(None, [])
    if len(roots) != 1:
        raise ValueError(f"clause with {len(roots)} outer expressions")
    return value(roots[0])


def clause_relationship(nodes: list, how: str) -> Relationship:
    """J-06 the edge that a clause of comparisons under AND states: equal pairs are its keys, the others are compared.

    Operands may stand either way round.  Clauses with OR or NOT, or between more
    than two tables, are no edge (``clause_condition`` reads them).
    """
    if any(x["op"].upper() in ("OR", "NOT") for x in nodes):
        raise ValueError("a clause with OR or NOT is no relationship")
    keys, compared, ends = [], [], None
    for x in nodes:
        if x["op"] not in COMPARISONS:
            continue
        operands = [re.match(_OPERAND, y["op"]) for y in nodes if y["parent"] == x["n"]]
        if len(operands) != 2 or None in operands:
            raise ValueError(f"clause with {x['op']} of other operands than two columns")
        (a, c), (b, d), op = operands[0].groups(), operands[1].groups(), x["op"]
        ends = ends or (a, b)
        if (b, a) == ends:
            a, c, b, d, op = b, d, a, c, _MIRROR.get(op, op)
        if (a, b) != ends:
            raise ValueError(f"clause between {ends[0]}, {ends[1]} and {a}, {b}")
        (keys.append((c, d)) if op == "=" else compared.append((c, op, d)))
    if ends is None:
        raise ValueError("a clause without comparisons")
    return Relationship(*ends, keys, how, None, tuple(compared))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """J-07: (vertex, component), component = the smallest vertex reachable.

    Alternating star contraction: every vertex's larger neighbours, then its
    smaller ones, are linked with the smallest vertex it sees.  The rounds grow
    with the logarithm of the component size, not with the diameter, and go on
    until nothing changes.  A round is grouped minima (combined map-side) and
    equi-joins, cut from the lineage by a reliable ``checkpoint``.  A vertex
    whose only edge is a self-loop is its own component.
    """
    from lodestar.session import checkpoint_dir

    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    state, mark = _settled(e.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    while True:
        state, after = _settled(_small_star(_large_star(state)))
        if after == mark:
            break
        mark = after
    linked = state.selectExpr("u AS vertex", "v AS component").union(state.selectExpr("v AS vertex", "v AS component").distinct())
    alone = e.filter("u = v").select(F.col("u").alias("vertex")).distinct().join(linked, "vertex", "left_anti")
    return linked.union(alone.selectExpr("vertex", "vertex AS component"))


# Edges that a partition holds between rounds; a graph of one partition needs no exchange.
_EDGES_PER_PARTITION = 200_000


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """A checkpoint of the edges in as many partitions as their count asks for, and a mark of their content."""
    kept = edges.checkpoint()
    mark = tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return kept.coalesce(max(1, -(-mark[0] // _EDGES_PER_PARTITION))), mark


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each of the pairs of columns."""
    return df.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(edges.join(least, "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct()


def edges_of_component(edges: DataFrame, components: DataFrame, src: str = "src") -> DataFrame:
    """J-08: attach the component id to each relationship (by its source vertex)."""
    return edges.join(components.withColumnRenamed("vertex", src), src, "inner")


def first_wins(df: DataFrame, partition_cols, order_col: str, name_col: str | None = None) -> DataFrame:
    """P-06: keep the first row per name (smallest ``order_col``).  ``min_by``
    over the row aggregates map-side, so a hot name is reduced per task."""
    from lodestar.operators.grouping import distinct_on

    return distinct_on(df, list(partition_cols), order_col).select(*df.columns)
