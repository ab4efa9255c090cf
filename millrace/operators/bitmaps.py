"""Bitmap indexes as tables: (key, segment, bitmap), one row for each key and segment of row ids that has any.

A segment covers a fixed range of row ids, so an index is built by one aggregate that combines map-side, and sets of
rows are combined segment by segment without ever being listed. A set of rows is (segment, bitmap). Row ids are not
negative; null keys have bitmaps too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, key: str, rid: str) -> DataFrame:
    """The index of a column."""
    place = df.select(F.col(key).alias("key"), F.bitmap_bucket_number(F.col(rid) + 1).alias("segment"), F.bitmap_bit_position(F.col(rid) + 1).alias("bit"))  # both count from 1
    return place.groupBy("key", "segment").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def splice(old: DataFrame, new: DataFrame) -> DataFrame:
    """An index with the rows of another one added."""
    return old.unionByName(new).groupBy("key", "segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def union(index: DataFrame) -> DataFrame:
    """The rows of all keys of an index."""
    return index.groupBy("segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy("segment").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    return both.where("n = 2").select("segment", "bitmap")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are not in b: segments of a alone as they are, others row by row of that segment."""
    other = b.select(F.col("segment"), F.col("bitmap").alias("less"))
    both = a.join(other, "segment", "left")
    alone = both.where("less IS NULL").select("segment", "bitmap")
    left = rows(both.where("less IS NOT NULL").select("segment", "bitmap"))
    gone = rows(both.where("less IS NOT NULL").select("segment", F.col("less").alias("bitmap")))
    kept = left.join(gone, ["segment", "rid"], "left_anti")
    again = kept.groupBy("segment").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("rid") + 1)).alias("bitmap"))
    return alone.unionByName(again)


def rows(sets: DataFrame) -> DataFrame:
    """The row ids of bitmaps; other columns stay."""
    byte = F.posexplode(F.split(F.regexp_replace(F.hex("bitmap"), "(..)", "$1,"), ",")).alias("at", "byte")
    some = sets.select(*(c for c in sets.columns if c != "bitmap"), byte).where("byte NOT IN ('', '00')")
    bits = some.withColumn("value", F.conv("byte", 16, 10).cast("int")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bits = bits.where(F.expr("getbit(value, bit) = 1"))
    return bits.withColumn("rid", (F.col("segment") - 1) * 32768 + F.col("at") * 8 + F.col("bit")).drop("at", "byte", "value", "bit")
