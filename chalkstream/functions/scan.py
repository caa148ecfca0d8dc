"""Running values over long ordered groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_max(df: DataFrame, part: str, block: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """df with out: the largest non-null value among this row and all rows of part before it.

    block is a non-decreasing function of the order, such as its leading digits; a window sees one block, and what
    earlier blocks hold comes from a window over one row for each block. Nulls of value are passed over.
    """
    w = W.partitionBy(part, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    near = df.withColumn(out, F.max(value).over(w))
    past = W.partitionBy(part).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carried = df.groupBy(part, block).agg(F.max(value).alias("__end")).select(part, block, F.max("__end").over(past).alias("__carry")).where("__carry is not null")
    return near.join(carried, [part, block], "left").withColumn(out, F.greatest(out, "__carry")).drop("__carry")


def numbered(df: DataFrame, part: str, block: str, order: list[Column | str], index: str = "i", total: str = "n") -> DataFrame:
    """df with the 0-based index of each row within part, and the number of rows of part.

    block is as in running_max: rows are numbered within a block, and blocks by a window over one row for each.
    """
    w = W.partitionBy(part, block).orderBy(*order)
    near = df.withColumn("__k", F.row_number().over(w) - 1)
    past = W.partitionBy(part).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy(part, block).agg(F.count(F.lit(1)).alias("__c"))
    blocks = blocks.select(part, block, F.coalesce(F.sum("__c").over(past), F.lit(0)).alias("__o"), F.sum("__c").over(W.partitionBy(part)).alias(total))
    return near.join(blocks, [part, block]).withColumn(index, F.col("__k") + F.col("__o")).drop("__k", "__o")


#: Rows of a block, and rows of its neighbours that it sees: frames of at most HALO rows are exact within blocks.
BLOCK, HALO = 4096, 64


def with_halo(df: DataFrame, index: str = "i") -> DataFrame:
    """Every row once with own = true in its block blk, and again with own = false in a block whose edge it is near."""
    blk, k = F.floor(F.col(index) / BLOCK), F.col(index) % BLOCK
    places = F.array_compact(
        F.array(
            F.struct(blk.alias("blk"), F.lit(True).alias("own")),
            F.when((k < HALO) & (blk > 0), F.struct((blk - 1).alias("blk"), F.lit(False).alias("own"))),
            F.when(k >= BLOCK - HALO, F.struct((blk + 1).alias("blk"), F.lit(False).alias("own"))),
        )
    )
    return df.withColumn("__p", F.explode(places)).withColumn("blk", F.col("__p.blk")).withColumn("own", F.col("__p.own")).drop("__p")


def running_sum(df: DataFrame, part: str, block: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over this row and all rows of part before it, block by block; nulls count as 0."""
    w = W.partitionBy(part, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    past = W.partitionBy(part).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(part, block).agg(F.sum(value).alias("__s")).select(part, block, F.coalesce(F.sum("__s").over(past), F.lit(0)).alias("__o"))
    near = df.withColumn("__r", F.sum(value).over(w))
    return near.join(sums, [part, block]).withColumn(out, F.coalesce("__r", F.lit(0)) + F.col("__o")).drop("__r", "__o")
