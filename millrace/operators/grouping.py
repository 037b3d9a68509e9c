"""Ranks, gaps and sums within groups: window expressions with ties settled by ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(group: list[str], score: str, *ties: str, nulls_unranked: bool = False) -> Column:
    """1 for the greatest score of a group; equal scores go by `ties`, ascending."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(score), *ties))
    return F.when(F.col(score).isNotNull(), rank) if nulls_unranked else rank


def best_in_group(df: DataFrame, group: list[str], score: str, *ties: str, k: int = 1, rank: str | None = None) -> DataFrame:
    """The k best rows of each group. The filter stands right on the rank, so only k rows a group are shuffled."""
    out = df.withColumn("_rank", ranked(group, score, *ties)).filter(F.col("_rank") <= k)
    return out.drop("_rank") if rank is None else out.withColumnRenamed("_rank", rank)


def runner_up(group: list[str], score: str, *ties: str) -> Column:
    """The group's second score, null in a group of one."""
    frame = Window.partitionBy(*group).orderBy(F.desc_nulls_last(score), *ties).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(score, 2).over(frame)


def gap_to_rival(group: list[str], score: str, *ties: str) -> Column:
    """The score less that of the best other row of its group: the runner-up's for the leader (0 without one)."""
    best = F.max(score).over(Window.partitionBy(*group))
    rival = F.when(ranked(group, score, *ties) == 1, F.coalesce(runner_up(group, score, *ties), F.lit(0.0))).otherwise(best)
    return F.col(score) - rival


def others_sum(group: list[str], value: Column) -> Column:
    """The group's sum without the row itself."""
    return F.sum(value).over(Window.partitionBy(*group)) - value


def size_of(group: list[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*group))
