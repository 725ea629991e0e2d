"""Fragments and candidate joins as views over the driver's tables.

The tables have no meshes. A fragment is a label of ``embeddings``: three
dimensions are a point, three its normal and three a second normal. A candidate
join is a row of ``lineitem`` whose two keys are brought into one domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.columns import norm, unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frag, vid, x, y, z, unit normals nx.. and fx.., area, is_fracture."""
    e = table(spark, sf_dir, "embeddings")
    d = lambda i: F.element_at("embedding", i).cast("double")
    raw = e.select(F.col("label").alias("frag"), F.col("vec_id").alias("vid"), *[d(i + 1).alias(c) for i, c in enumerate(("x", "y", "z", "n1", "n2", "n3", "f1", "f2", "f3"))], F.abs(d(10)).alias("area"), (d(11) > 0).alias("is_fracture"))
    n, f = unit(["n1", "n2", "n3"]), unit(["f1", "f2", "f3"])
    return raw.select("frag", "vid", "x", "y", "z", *[c.alias(k) for c, k in zip([*n, *f], ("nx", "ny", "nz", "fx", "fy", "fz"))], "area", "is_fracture")


POINTS_SQL = """
raw AS (SELECT label AS frag, vec_id AS vid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  CAST(embedding[4] AS DOUBLE) AS n1, CAST(embedding[5] AS DOUBLE) AS n2, CAST(embedding[6] AS DOUBLE) AS n3,
  CAST(embedding[7] AS DOUBLE) AS f1, CAST(embedding[8] AS DOUBLE) AS f2, CAST(embedding[9] AS DOUBLE) AS f3,
  abs(CAST(embedding[10] AS DOUBLE)) AS area, embedding[11] > 0 AS is_fracture FROM embeddings),
pts AS (SELECT frag, vid, x, y, z, n1 / greatest(sqrt(n1*n1 + n2*n2 + n3*n3), 1e-12) AS nx, n2 / greatest(sqrt(n1*n1 + n2*n2 + n3*n3), 1e-12) AS ny, n3 / greatest(sqrt(n1*n1 + n2*n2 + n3*n3), 1e-12) AS nz,
  f1 / greatest(sqrt(f1*f1 + f2*f2 + f3*f3), 1e-12) AS fx, f2 / greatest(sqrt(f1*f1 + f2*f2 + f3*f3), 1e-12) AS fy, f3 / greatest(sqrt(f1*f1 + f2*f2 + f3*f3), 1e-12) AS fz, area, is_fracture FROM raw)"""


def fragments(pts: DataFrame) -> DataFrame:
    """frag, t (median distance of its points), res, n_points, area."""
    g = pts.groupBy("frag").agg(F.median(norm(["x", "y", "z"])).alias("t"), F.count(F.lit(1)).alias("n_points"), F.sum("area").alias("area"))
    return g.withColumn("res", F.col("t") * 0.1)


FRAGMENTS_SQL = POINTS_SQL + """,
frags AS (SELECT frag, median(sqrt(x*x + y*y + z*z)) AS t, count(*) AS n_points, sum(area) AS area, median(sqrt(x*x + y*y + z*z)) * 0.1 AS res FROM pts GROUP BY frag)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b (a < b), score, accepted, seam, tight, gap, pen, cont, slide (null where it can't be measured) and ord, which orders all rows."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))  # one row
    i = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))
    other = F.pmod(F.col("l_partkey"), F.col("n"))
    c = i.where(F.col("l_suppkey") != other).select(
        F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b"), (F.col("l_extendedprice") * F.col("l_discount")).alias("score"),
        (F.col("l_returnflag") != "R").alias("accepted"), F.col("l_quantity").alias("seam"), (F.col("l_discount") * 10).alias("tight"), F.col("l_tax").alias("gap"),
        (F.col("l_tax") / 10).alias("pen"), (1 - F.col("l_discount") * 3).alias("cont"), F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 5).alias("slide"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )
    return c


CANDIDATES_SQL = """
cand AS (SELECT least(l_suppkey, l_partkey % n) AS a, greatest(l_suppkey, l_partkey % n) AS b, l_extendedprice * l_discount AS score, l_returnflag <> 'R' AS accepted,
  l_quantity AS seam, l_discount * 10 AS tight, l_tax AS gap, l_tax / 10 AS pen, 1 - l_discount * 3 AS cont, CASE WHEN l_linestatus = 'O' THEN l_tax * 5 END AS slide,
  l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4
  FROM lineitem, (SELECT count(*) AS n FROM supplier) WHERE l_suppkey <> l_partkey % n)"""
