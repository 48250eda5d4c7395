"""Exact order statistics of a whole column without one task that holds it.

Values go to bins by their logarithm, which keeps their order. Bins are counted, the one or two that hold the wanted ranks are
found, and only their values are counted by value. Each step groups before it gathers: what one task sees are bins (some thousands
an octave) and then the distinct values of two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins in a doubling of the value.
FINE = 1024


def bin_of(value: Column) -> Column:
    """A number that does not fall as the value grows."""
    size = F.floor(F.log2(F.abs(value)) * FINE).cast("long") + (1 << 24)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def quantile(rows: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """One row: the value at `share` of the sorted, non-null values, between two ranks by interpolation; null without values.

    rows is read twice: store it first if it is dear.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    bins = v.groupBy(bin_of(F.col("v")).alias("bin")).agg(F.count("*").alias("n"))
    every = Window.orderBy("bin")  # bins, not values
    bins = bins.withColumn("before", F.sum("n").over(every) - F.col("n")).withColumn("place", share * (F.sum("n").over(Window.partitionBy()) - 1))
    held = bins.filter((F.col("before") <= F.ceil("place")) & (F.col("before") + F.col("n") > F.floor("place"))).select("bin", "before", "place")
    # at most two bins hold both ranks
    some = v.withColumn("bin", bin_of(F.col("v"))).join(F.broadcast(held), "bin").groupBy("v").agg(F.count("*").alias("n"), F.first("place").alias("place"))
    first = held.agg(F.min("before").alias("skip"))
    counted = some.crossJoin(F.broadcast(first)).withColumn("upto", F.col("skip") + F.sum("n").over(Window.orderBy("v")))  # one row beside each value
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    ends = counted.agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.first("place").alias("place"))
    return ends.select((F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias(name))
