"""IO-10 business table scan: the driver's parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables_stamp(spark: SparkSession, sf_dir: str, names=("region", "nation", "customer", "supplier", "part", "orders")) -> tuple:
    """Size and modification time of the tables: what is memoized by it is made anew when a table changes."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((name, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def register_views(spark: SparkSession, sf_dir: str, names=TABLE_NAMES) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


class Tables:
    """Lazy accessor: ``Tables(spark, d).orders`` reads one parquet table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from lodestar.session import configure, ship_library

        self.spark = configure(spark)
        ship_library(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            df = read_table(self.spark, self.sf_dir, name)
            setattr(self, name, df)
            return df
        raise AttributeError(name)

    @cached_property
    def star(self) -> DataFrame:
        """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region (the sample's ORDERS stand-in)."""
        from lodestar.operators.joins import Relationship, star_join

        edges = [
            Relationship("lineitem", "orders", [("l_orderkey", "o_orderkey")], "inner"),
            Relationship("orders", "customer", [("o_custkey", "c_custkey")], "inner"),
            Relationship("customer", "nation", [("c_nationkey", "n_nationkey")], "inner"),
            Relationship("nation", "region", [("n_regionkey", "r_regionkey")], "inner"),
        ]
        frames = {n: getattr(self, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
        return star_join(frames, edges)

    @cached_property
    def order_star(self) -> DataFrame:
        """Eager aggregation for order-grain questions: ``lineitem`` measures are
        summed per order (map-side combine, one shuffle on the order key)
        before the dimension joins, so the largest table crosses the network
        once, already reduced, and the join to ``orders`` reuses that
        partitioning.  Columns: ext, qty, lines + every dimension column."""
        from pyspark.sql import functions as F

        from lodestar.operators.joins import Relationship, star_join

        facts = self.lineitem.groupBy("l_orderkey").agg(
            F.sum("l_extendedprice").alias("ext"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines")
        )
        edges = [
            Relationship("facts", "orders", [("l_orderkey", "o_orderkey")], "inner"),
            Relationship("orders", "customer", [("o_custkey", "c_custkey")], "inner"),
            Relationship("customer", "nation", [("c_nationkey", "n_nationkey")], "inner"),
            Relationship("nation", "region", [("n_regionkey", "r_regionkey")], "inner"),
        ]
        frames = {"facts": facts, **{n: getattr(self, n) for n in ("orders", "customer", "nation", "region")}}
        return star_join(frames, edges)
