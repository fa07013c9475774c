"""Places in a whole order, and many-to-one joins that hot keys don't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.session import checkpoint

#: Rows up to which the one-side of a join is broadcast; beyond, only keys with more than 1 / COMMON of all rows are: fewer than COMMON.
SMALL, COMMON = 100_000, 1000


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df, a table that can be read twice, with each row's place in the order, from 0; rows stay range-partitioned and sorted.

    A range sort gives a row its partition and its place there; what is added up on one task is a row per partition.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = checkpoint(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part, place = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = here.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    shifts = counts.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("shift"))
    return here.join(F.broadcast(shifts), part == F.col("part")).withColumn(name, F.col("shift") + place).drop("part", "shift")


def attached(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner", small: int = SMALL) -> tuple[DataFrame, bool]:
    """left joined with right, a written table of one row per key with ``many``, its rows in left; and whether left's partitions are as they were.

    A right side of up to ``small`` rows is broadcast. A larger one is shuffled, but for the keys that
    hold more than 1 / COMMON of left's ``rows``: those, fewer than COMMON, are broadcast.
    """
    if right.limit(small + 1).count() <= small:
        return left.join(F.broadcast(right.drop("many")), key, how), True
    common = F.broadcast(right.filter(F.col("many") > rows // COMMON).drop("many"))
    rest = left.join(common.select(key), key, "left_anti").join(right.drop("many"), key, how)
    return left.join(common, key).unionByName(rest), False
