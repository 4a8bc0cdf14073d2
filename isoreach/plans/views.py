"""Domain views of the star-schema tables: demand, existing sites, candidates and a road lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(key: str, x: int, y: int) -> list[Column]:
    return [(((F.col(key) * x) % 10007).cast("double")/ F.lit(1000.0)).alias("lon"), (((F.col(key) * y) % 10009).cast("double")/ F.lit(1000.0)).alias("lat")]


def placed_demand(customers: DataFrame) -> DataFrame:
    weight = F.floor(F.abs("c_acctbal")).cast("long").alias("weight")
    return customers.select(F.col("c_custkey").alias("demand_id"), *_placed("c_custkey", 7919, 104729), weight)


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_demand(table(spark, sf_dir, "customer"))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("facility_id"), *_placed("s_suppkey", 6101, 3571))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("facility_id"), *_placed("p_partkey", 2741, 8089))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges of a lattice of width 50 over the customer keys, without every 17th node."""
    nodes = table(spark, sf_dir, "customer").where("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("u"))
    length = (1 + (F.col("u") * 37) % 11).cast("double").alias("length")
    step = F.explode(F.array(F.lit(1), F.lit(50))).alias("step")
    out = nodes.select("u", step, length).select("u", (F.col("u") + F.col("step")).alias("v"), "length")
    out = out.join(nodes.select(F.col("u").alias("v")), "v", "left_semi")
    return out.select("u", "v", "length").union(out.select("v", "u", "length"))


#: The views as SQL, for checks by an independent engine.
SQL = """
demand as (select c_custkey as demand_id, cast(c_custkey * 7919 % 10007 as double) / 1000.0::double as lon,
  cast(c_custkey * 104729 % 10009 as double) / 1000.0::double as lat, cast(floor(abs(c_acctbal)) as bigint) as weight from customer),
existing as (select s_suppkey as facility_id, cast(s_suppkey * 6101 % 10007 as double) / 1000.0::double as lon,
  cast(s_suppkey * 3571 % 10009 as double) / 1000.0::double as lat from supplier),
candidates as (select p_partkey as facility_id, cast(p_partkey * 2741 % 10007 as double) / 1000.0::double as lon,
  cast(p_partkey * 8089 % 10009 as double) / 1000.0::double as lat from part)"""
