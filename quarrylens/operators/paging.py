"""Pages of totally ordered results, and number ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import declared_length


@dataclass(frozen=True)
class Notice:
    """What precedes the rows of a page."""

    total: int
    offset: int
    shown: int
    hint: str = ""

    @property
    def more(self) -> bool:
        return self.offset + self.shown < self.total

    @property
    def past_end(self) -> bool:
        return self.offset >= self.total > 0


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; order must end in a unique column. Spark keeps the first limit + offset rows of each task only."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0, hint: str = "") -> tuple[DataFrame, Notice]:
    total = df.count()
    return page(df, order, limit, offset), Notice(total, offset, max(0, min(limit, total - offset)), hint)


def page_parts(parts: list[tuple[DataFrame, list[Column]]], limit: int, offset: int = 0) -> list[DataFrame]:
    """One page over parts that follow each other; whole parts before the page are only counted."""
    out = []
    for df, order in parts:
        n = df.count()
        if offset >= n:
            offset -= n
            continue
        if limit <= 0:
            break
        out.append(page(df, order, limit, offset))
        limit -= min(limit, n - offset)
        offset = 0
    return out


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def round_robin(df: DataFrame, group: str, group_order: Column, order: list[Column]) -> DataFrame:
    """Rows interleaved: the first of every group, then the second; adds rn and pos."""
    return numbered(df, [group], order).withColumn("pos", group_order)


def table_coverage(tables: DataFrame, present: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, declared, present, ranges): for each table (keys, signature) whose signature holds exactly one [N] the numbers
    from 0 to N - 1 that present (keys, number) lacks, as text; tables that lack none have no ranges."""
    sized = tables.select(*keys, declared_length(F.col("signature")).alias("declared")).where("declared > 0")
    have = present.select(*keys, number).where(F.col(number).isNotNull()).distinct()
    counted = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("present"))
    due = sized.select(*keys, F.explode(F.sequence(F.lit(0), F.col("declared") - 1)).alias(number))
    gaps = number_ranges(due.join(have, [*keys, number], "left_anti"), keys, number)
    return sized.join(counted, keys, "left").join(gaps, keys, "left").select(*keys, "declared", F.coalesce("present", F.lit(0)).alias("present"), "ranges")


def number_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, ranges): the numbers of each key as text like "89, 198-200". Runs are found by gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = df.select(*keys, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    runs = runs.groupBy(*keys, "island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    told = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("x"))
    return told.select(*keys, F.array_join(F.transform("x", lambda r: r["t"]), ", ").alias("ranges"))
