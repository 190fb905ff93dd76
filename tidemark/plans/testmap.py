"""The given tables read as a change log: orders are commits, order lines are the files they touch.

commits(sha, author, email, ts, subject, is_revert, n_files, insertions, deletions, churn)
commit_files(sha, path, clade, layer, insertions, deletions)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str, more: DataFrame | None = None) -> DataFrame:
    """The files of commits; with ``more`` (sha and other columns), of those commits, with these columns and no further shuffle of the files."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if more is not None:
        lines = lines.repartition(F.col("l_orderkey"))
    per_file = lines.groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("insertions"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).cast("bigint").alias("deletions"),
    )
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string"))
    own = () if more is None else tuple(c for c in more.columns if c != "sha")
    if more is not None:
        per_file = per_file.join(more.withColumnRenamed("sha", "_sha"), per_file["l_orderkey"] == F.col("_sha"))
    return per_file.join(part, per_file["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("sha"), path.alias("path"), F.col("p_brand").alias("clade"), F.col("p_type").alias("layer"), "insertions", "deletions", *own
    )


def commit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits without what their files add up to."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .select(
            F.col("o_orderkey").alias("sha"), F.col("n_name").alias("author"), F.col("o_custkey").alias("email"), F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_orderpriority").alias("subject"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("is_revert"),
        )
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.countDistinct("l_partkey").alias("n_files"),
        F.sum("l_quantity").cast("bigint").alias("insertions"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).cast("bigint").alias("deletions"),
    )
    headers = commit_headers(spark, sf_dir)
    out = headers.join(totals, headers["sha"] == totals["l_orderkey"], "left").drop("l_orderkey")
    out = out.fillna(0, ["n_files", "insertions", "deletions"])
    return out.withColumn("churn", F.col("insertions") + F.col("deletions"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, parent, pos): the customer's previous order, and for every tenth order the nation's as a second parent."""
    head = commit_headers(spark, sf_dir)
    own = Window.partitionBy("email").orderBy("ts", "sha")
    land = Window.partitionBy("author").orderBy("ts", "sha")
    both = head.select("sha", F.lag("sha").over(own).alias("p0"), F.when(F.col("sha") % 10 == 0, F.lag("sha").over(land)).alias("p1"))
    rows = both.select("sha", F.posexplode(F.array("p0", "p1")).alias("pos", "parent")).filter("parent is not null")
    return rows


#: The same tables for the SQL that checks the queries.
SQL_FILES = """files AS (
  SELECT l_orderkey AS sha, p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey AS path, max(p_brand) AS clade, max(p_type) AS layer,
         CAST(sum(l_quantity) AS BIGINT) AS insertions,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS deletions
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
SQL_HEADERS = """headers AS (
  SELECT o_orderkey AS sha, n_name AS author, o_custkey AS email, o_orderdate AS ts, o_orderpriority AS subject,
         o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS is_revert
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SQL_COMMITS = (
    SQL_FILES
    + ",\n"
    + SQL_HEADERS
    + """,
totals AS (SELECT sha, count(*) AS n_files, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions FROM files GROUP BY 1),
commits AS (
  SELECT h.*, coalesce(n_files, 0) AS n_files, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions,
         coalesce(insertions, 0) + coalesce(deletions, 0) AS churn
  FROM headers h LEFT JOIN totals USING (sha))"""
)
SQL_PARENTS = (
    SQL_HEADERS
    + """,
lags AS (SELECT sha, lag(sha) OVER (PARTITION BY email ORDER BY ts, sha) AS p0,
                CASE WHEN sha % 10 = 0 THEN lag(sha) OVER (PARTITION BY author ORDER BY ts, sha) END AS p1 FROM headers),
parents AS (SELECT sha, 0 AS pos, p0 AS parent FROM lags WHERE p0 IS NOT NULL UNION ALL SELECT sha, 1, p1 FROM lags WHERE p1 IS NOT NULL)"""
)
