"""Ranks and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_unique(score: str, tie: str, by: list[str] = ()) -> Column:
    """0-based rank by falling score, ties by ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))).cast("long") - 1


def rank_average(score: str, by: list[str] = ()) -> Column:
    """0-based rank by falling score; equal scores share the mean of their places."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(F.col(score).desc())) - 1
    return place + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """``rank_correlation`` by group; null where a list is constant (undefinedRankCorrelation)."""
    ranked = df.select(*by, rank_average(a, by).alias("ra"), rank_average(b, by).alias("rb"))
    moments = ranked.groupBy(*by).agg(F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return moments.select(*by, F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("c") / (F.col("sa") * F.col("sb"))).alias("rank_correlation"))
