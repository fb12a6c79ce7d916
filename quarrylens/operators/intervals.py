"""Containment joins between lines and line ranges of the same file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import CALLABLE
from quarrylens.operators.merge import SITE


def contain(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, bucket: int = 64) -> DataFrame:
    """Points beside the ranges of the same keys that hold them.

    Both sides are cut into buckets of lines and joined on keys and bucket, an equi-join that no file with many ranges
    turns into a product; a range is repeated once per bucket that it touches.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    spread = ranges.where(F.col(high) >= F.col(low)).withColumn("__b", F.explode(F.sequence(b(low), b(high))))
    return points.withColumn("__b", b(at)).join(spread, [*keys, "__b"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__b")


def enclosing_callable(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site columns, enclosing_usr): the innermost callable definition around each reference's line."""
    ranges = symbols.where((F.col("is_definition") == 1) & (F.col("end_line") > 0) & F.col("kind").isin(*CALLABLE)).select(
        "config_hash", F.col("file_path").alias("from_file"), F.col("usr").alias("enclosing_usr"), F.col("line").alias("lo"), F.col("end_line").alias("hi")
    )
    points = refs.select("id", "config_hash", "from_file", "from_line")
    held = contain(points, ranges, ["config_hash", "from_file"], "from_line", "lo", "hi")
    return held.groupBy("id", "config_hash", "from_file", "from_line").agg(F.min_by("enclosing_usr", F.struct((F.col("hi") - F.col("lo")).alias("n"), "enclosing_usr")).alias("enclosing_usr"))


def repair_callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References without a caller get the enclosing callable; where the same site with that caller exists they go."""
    open_refs, known = refs.where("from_usr is null"), refs.where("from_usr is not null")
    found = enclosing_callable(open_refs, symbols).select("id", "enclosing_usr")
    mended = open_refs.join(found, "id", "left").withColumn("from_usr", F.col("enclosing_usr")).drop("enclosing_usr")
    slot = F.coalesce("slot_index", F.lit(-1))
    twins = known.select(*SITE, slot.alias("__s"), "from_usr").distinct()
    kept = mended.withColumn("__s", slot).join(twins, [*SITE, "__s", "from_usr"], "left_anti").drop("__s").select(*refs.columns)
    return known.unionByName(kept)


def owning_array(elements: DataFrame, arrays: DataFrame) -> DataFrame:
    """Elements beside the one array variable whose lines hold them; elements with several owners are left out."""
    ranges = arrays.select("config_hash", F.col("file_path").alias("from_file"), F.col("usr").alias("array_usr"), F.col("line").alias("lo"), F.greatest("line", "end_line").alias("hi"))
    held = contain(elements, ranges, ["config_hash", "from_file"], "from_line", "lo", "hi")
    return held.groupBy(*elements.columns).agg(F.min("array_usr").alias("array_usr"), F.max("array_usr").alias("other")).where("array_usr = other").drop("other")


def latest_before(points: DataFrame, starts: DataFrame, keys: list[str], at: str, line: str, value: str) -> DataFrame:
    """Each point with the value of the last start at or before its line (a correlated innermost-context lookup).

    Both streams are merged in line order; the last value seen is carried forward.
    """
    cols = [c for c in points.columns if c not in keys]
    a = points.select(*keys, F.col(at).alias("__l"), F.lit(1).alias("__k"), F.lit(None).alias("__v"), F.struct(*cols).alias("__p"))
    b = starts.select(*keys, F.col(line).alias("__l"), F.lit(0).alias("__k"), F.col(value).alias("__v"), F.lit(None).alias("__p"))
    w = Window.partitionBy(*keys).orderBy("__l", "__k", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__k = 1").select(*keys, "__p.*", F.col("__v").alias(value))
