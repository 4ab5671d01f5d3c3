"""The relational tables as histories, graphs and files for the operators.

Orders are commits (hash: order, author: customer, repository: priority) and
their lines are changed files (path: part or brand, added: quantity, deleted:
line number). Supplier and customer nations are the ends of import edges.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators.steps import kept, parts_of

#: The end of the order history: windows look back from here, never from the wall clock.
AS_OF = dt.datetime(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("repo_id"), F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))


def changes(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    """One row for each line of an order; the path is the part, or its brand."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), "l_partkey", F.col("l_quantity").cast("int").alias("added"), F.col("l_linenumber").alias("deleted"))
    # Commits come last, so that all files of a commit are in one place for what groups them.
    if by_brand:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
        lines = lines.join(part, "l_partkey")
    out = commits(spark, sf_dir).join(lines, "hash")
    if not by_brand:
        out = out.withColumn("path", F.format_string("part-%08d", "l_partkey"))
    return out.select("repo_id", "hash", "author", "ts", "path", "added", "deleted")


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """All lines with their orders and the brands of their parts, joined once for what reads them several times, and
    the number of partitions that so many rows are dealt to. ``by_part`` and ``by_brand`` make ``changes`` of them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), "l_partkey", F.col("l_quantity").cast("int").alias("added"), F.col("l_linenumber").alias("deleted"))
    parts = parts_of(lines.count())
    # A list, as a part that is not listed, or is twice, must not change the lines.
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct(F.col("p_brand").alias("path"))).alias("brands"))
    known = lines.repartition(parts, "l_partkey").join(brands, "l_partkey", "left").repartition(parts, "hash")
    return kept(commits(spark, sf_dir).join(known, "hash")), parts


def by_part(lines: DataFrame) -> DataFrame:
    """``changes`` of a ``history``."""
    return lines.select("repo_id", "hash", "author", "ts", F.format_string("part-%08d", "l_partkey").alias("path"), "added", "deleted")


def by_brand(lines: DataFrame) -> DataFrame:
    """``changes`` of a ``history`` by brands; lines of parts that are not listed have none."""
    return lines.select("repo_id", "hash", "author", "ts", F.explode("brands").alias("b"), "added", "deleted").select("repo_id", "hash", "author", "ts", "b.path", "added", "deleted")


CHANGES_SQL = """
  SELECT o_orderpriority AS repo_id, o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts,
         printf('part-%08d', l_partkey) AS path, CAST(l_quantity AS INT) AS added, l_linenumber AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
BRANDS_SQL = """
  SELECT o_orderpriority AS repo_id, o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts,
         p_brand AS path, CAST(l_quantity AS INT) AS added, l_linenumber AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation to customer nation, a repository for each region of the supplier and order year."""
    nation = table(spark, sf_dir, "nation")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    src = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src"), F.col("n_regionkey").alias("r1"))
    dst = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("r2"))
    # A line reaches a pair of nations; pairs are few, so they are made distinct before names are joined.
    pairs = line.join(supplier, "l_suppkey").join(orders, "l_orderkey").join(customer, "o_custkey").select("s_nationkey", "c_nationkey", F.year("o_orderdate").alias("y")).distinct()
    named = pairs.join(src, "s_nationkey").join(dst, "c_nationkey").where("src != dst and r1 = r2")
    return named.select(F.concat_ws("-", F.col("r1").cast("string"), F.col("y").cast("string")).alias("repo_id"), "src", "dst").distinct()


EDGES_SQL = """
  SELECT DISTINCT CAST(a.n_regionkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS repo_id, a.n_name AS src, b.n_name AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
  WHERE a.n_name <> b.n_name AND a.n_regionkey = b.n_regionkey
"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each customer: the class of an order (priority and status) to that of the customer's next order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo_id"), "o_orderdate", "o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("src"))
    order = Window.partitionBy("repo_id").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("dst", F.lead("src").over(order)).where("src != dst").select("repo_id", "src", "dst").distinct()


ORDER_EDGES_SQL = """
  SELECT DISTINCT repo_id, src, dst FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS repo_id, o_orderpriority || '/' || o_orderstatus AS src,
      lead(o_orderpriority || '/' || o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE src <> dst
"""
