"""Joins of many rows with many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left rows of a key that meet its right rows in one task.
ROWS = 2000


def meet(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str, by: str) -> DataFrame:
    """left joined with right on key, with the columns of sizes (key, size: left rows of the key).

    Left rows of a large key are dealt into parts of about ROWS by a hash of `by`; its right rows go to every part.
    """
    parts = F.ceil(F.col("size") / ROWS)
    dealt = left.join(sizes, key).withColumn("part", F.pmod(F.xxhash64(by), parts))
    copies = right.join(sizes.select(key, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")), key)
    return dealt.join(copies, [key, "part"]).drop("part")
