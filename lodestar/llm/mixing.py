"""Mixing sources to target weights by hierarchical budgeting (operator 4).

A tree of domains, their languages and their sources gets a token budget at the
root.  On every level a node's budget goes to its children by weight; a child
holds at most its capacity (the tokens below it times the allowed epochs), and
what it cannot hold goes to its siblings by their weights, until none is short.
Because a node's capacity is the sum below it, a shortage leaves a node only when
all of its children are full: siblings come before ancestors.

Each leaf then takes whole epochs and, of the last one, a token prefix of the
leaf's documents in that epoch's seeded order.

All budgets are integers: a child gets the floor of its share, so the total can
fall short by less than a token a node.  A document of the prefix is taken if
the tokens before it are fewer than the budget (the last one may exceed it).
Equal order keys (repeated rows) go by id, text and source, nulls first.

Defined results: a null text has no tokens; null domain, language or source
values are leaves of their own, named by the empty string; documents without
tokens are taken with the epoch's prefix that they fall in; leaves without
weight get nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD_SPLIT_SQL, checkpoint, table

#: Leaves (a row of some dozen bytes each) up to which their table is broadcast.
MAX_BROADCAST_LEAVES = 50_000
#: Hex digits of the order key that deal a leaf's documents into ranges (16**3 ranges a leaf).
RANGE_DIGITS = 3
SEED = 11

#: Production weights of the query and the pipeline: whole numbers, by level.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forums": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "es": 2, "fr": 2}
#: Percent of the table's tokens that the mixture holds, and how often a document may be taken.
BUDGET_PERCENT, MAX_EPOCHS = 80, 2


def tokens(text: Column) -> Column:
    """Words of a text: runs of other characters than ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT_SQL)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def weight_of(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, w in weights.items():
        out = F.when(F.col(column) == k, w).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Divides each parent's ``budget`` among its children (``weight``, ``cap``) into ``given``.

    Children in the order of capacity by weight: those whose capacity is within
    the level that the rest of the budget allows are full, the others share the rest.
    """
    by_fill = [F.col("cap") / F.col("weight"), F.col("name")]
    before = Window.partitionBy(*parents).orderBy(*by_fill).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = nodes.filter("weight > 0").withColumns({"rest": rest, "weights": weights}).withColumn("full", F.expr("cap * weights <= weight * rest"))
    open_rest = F.max(F.when(~F.col("full"), F.struct("weights", "rest"))).over(whole)  # the first that is not full: most weight is left
    shared = level.withColumn("o", open_rest).withColumn("given", F.expr("CASE WHEN full THEN cap ELSE (weight * o.rest) div o.weights END"))
    return shared.drop("rest", "weights", "full", "o")


def leaf_budgets(leaves: DataFrame, budget: Column | int, max_epochs: int, weights: list[Column]) -> DataFrame:
    """(domain, lang, source, total, given) of leaves (domain, lang, source, total tokens)."""
    cap = leaves.withColumn("cap", F.col("total") * max_epochs)
    path = ["domain", "lang", "source"]
    root = cap.agg(F.sum("total").alias("all")).select(budget if isinstance(budget, Column) else F.lit(budget).cast("long"))
    parent, keys = None, []
    for depth, name in enumerate(path):
        own = path[: depth + 1]
        nodes = cap.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", weights[depth]).withColumn("name", F.col(name))
        # the root is a single value; below it each node is joined with its parent
        nodes = nodes.join(parent, keys) if keys else nodes.withColumn("budget", root.scalar())
        parent = _share(nodes, keys).select(*own, F.col("given").alias("budget"))
        keys = own
    return leaves.join(parent, path).withColumnRenamed("budget", "given")


def order_key(epoch: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _small(df: DataFrame) -> DataFrame:
    """A leaf table, materialised; broadcast where its counted rows are within the bound, joined by exchange beyond it."""
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_LEAVES else kept


def mix(docs: DataFrame, budget: Column | int, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: list[Column] | None = None) -> DataFrame:
    """Adds ``copies`` (times taken) to documents with domain, lang, source, doc_id, text and n_tokens; those taken never are left out.

    The order within a leaf needs no sort of the leaf: its keys are dealt into
    ranges, the ranges' token sums are accumulated, and only the rows of the range
    in which the prefix ends are shuffled and ordered.  So a leaf with a third of
    all rows is never in one task.
    """
    weights = weights or [weight_of("domain", DOMAIN_WEIGHTS, 1), weight_of("lang", LANG_WEIGHTS, 1), F.lit(1).cast("long")]
    path = ["domain", "lang", "source"]
    leaves = docs.groupBy(*path).agg(F.sum("n_tokens").alias("total"))
    given = _small(
        leaf_budgets(leaves, budget, max_epochs, weights).select(
            *path,
            F.expr("CASE WHEN total > 0 THEN given div total ELSE 0 END").alias("epochs"),
            F.expr("CASE WHEN total > 0 THEN given % total ELSE 0 END").alias("part"),
        )
    )

    def placed(limits: DataFrame) -> DataFrame:
        # the number of the last epoch enters the key
        keyed = docs.join(limits, path).withColumn("key", order_key(F.col("epochs"), seed))
        return keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS))

    sums = placed(given).groupBy(*path, "epochs", "part", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    before = Window.partitionBy(*path).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)))
    cuts = starts.groupBy(*path, "epochs", "part").agg(F.max(F.when(F.col("start") < F.col("part"), F.struct("range", "start"))).alias("cut"))
    rows = placed(_small(cuts))
    settled = rows.filter("cut IS NULL OR range <> cut.range").withColumn("taken", F.expr("cut IS NOT NULL AND range < cut.range"))
    within = Window.partitionBy(*path).orderBy("key", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter("range = cut.range").withColumn("taken", F.col("cut.start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) < F.col("part"))
    both = settled.unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("taken").cast("int")).cast("int"))
    return both.filter("copies > 0").drop("epochs", "part", "cut", "key", "range", "taken")


def domain_of(source: Column) -> Column:
    """The domain of a source: that of its number by three."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "forums"))), (number % 3 + 1).cast("int"))


def mixture(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The production mixture: doc_id, text, domain, lang, source, n_tokens, copies, and ``row``: the whole input row."""
    placed = docs.select(
        "doc_id",
        "text",
        domain_of(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        tokens(F.col("text")).alias("n_tokens"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return mix(placed, F.expr(f"all * {budget_percent} div 100"), max_epochs)


def mixed_rows(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of the mixture with the input's columns, each as often as it is taken."""
    taken = mixture(docs, budget_percent, max_epochs)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(level: str, keys: str, parent: str, weight: str, name: str) -> str:
    on = " AND ".join(f"n.{k} = p.{k}" for k in keys.split(", "))
    return f"""
{level}_n AS (SELECT n.*, p.budget, {weight} AS weight FROM {level}_caps n JOIN {parent} p ON {on}),
{level}_r AS (SELECT *, budget - coalesce(sum(cap) OVER b, 0) AS rest,
    sum(weight) OVER (PARTITION BY {keys}) - coalesce(sum(weight) OVER b, 0) AS weights
  FROM {level}_n WHERE weight > 0
  WINDOW b AS (PARTITION BY {keys} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{level}_o AS (SELECT {keys}, max(weights) AS ow, max_by(rest, weights) AS orest FROM {level}_r WHERE cap * weights > weight * rest GROUP BY {keys}),
{level} AS (SELECT r.*  EXCLUDE (budget), CASE WHEN cap * weights <= weight * rest THEN cap ELSE (weight * orest) // ow END AS budget
  FROM {level}_r r LEFT JOIN {level}_o n ON {on.replace('p.', 'r.')})"""


def _case(column: str, weights: dict[str, int], default: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {default} END"


MIXING_SQL = f"""
WITH docs AS (
  SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    (['web', 'books', 'forums'])[coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 3 + 1] AS domain,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS total, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS cap FROM docs GROUP BY domain, lang, source),
top AS (SELECT 0 AS root, CAST(sum(total) AS BIGINT) * {BUDGET_PERCENT} // 100 AS budget FROM leaves),
d_caps AS (SELECT root, domain, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY root, domain),
l_caps AS (SELECT root, domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY root, domain, lang),
s_caps AS (SELECT root, domain, lang, source, cap FROM leaves),
{_level_sql("d", "root", "top", _case("n.domain", DOMAIN_WEIGHTS, 1), "domain")},
{_level_sql("l", "root, domain", "d", _case("n.lang", LANG_WEIGHTS, 1), "lang")},
{_level_sql("s", "root, domain, lang", "l", "1", "source")},
given AS (SELECT s.domain, s.lang, s.source, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS epochs, CASE WHEN total > 0 THEN budget % total ELSE 0 END AS part
  FROM s JOIN leaves USING (domain, lang, source)),
placed AS (SELECT docs.*, epochs, part, md5('{SEED}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM docs JOIN given USING (domain, lang, source)),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id NULLS FIRST, text NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN before < part THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM summed WHERE epochs + CASE WHEN before < part THEN 1 ELSE 0 END > 0
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": MIXING_SQL}
