"""Per-key results when a few keys hold most records.

Multi-level tree aggregation: every input chunk (a task's split, of fixed size) is combined where it is read, then
states are merged in rounds of at most fan_in partial states per key, so that no reducer ever receives the partial
states of all chunks. The number of rounds is the logarithm of the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import column, filled, materialize

FAN_IN = 16

#: How two states of an aggregate merge.
MERGE: dict[str, Callable[[str], Column]] = {
    "count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or, "bool_or": F.bool_or,
}


def tree_aggregate(
    df: DataFrame, keys: list[str], states: dict[str, tuple[str, Column]], fan_in: int = FAN_IN, chunks: int | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Aggregate by keys through a tree of merges.

    states maps an output name to (kind, first aggregate), as {"n": ("count", F.count(F.lit(1)))}; kind is one of MERGE.
    chunk numbers the input chunks from 0 to chunks - 1; by default it is the task that reads the row, and df must then
    be a plan without a shuffle. Null keys form a group of their own; an empty table gives no rows.
    """
    if chunk is None:
        chunk, chunks = F.spark_partition_id(), df._jdf.queryExecution().toRdd().getNumPartitions()
    chunks = max(1, chunks or 1)
    level = df.withColumn("__chunk", chunk)
    first = True
    while True:
        chunks = -(-chunks // fan_in)
        by = [column(k) for k in keys]
        if chunks > 1:
            by.append(F.floor(F.col("__chunk") / fan_in).alias("__chunk"))
        aggs = [(agg if first else MERGE[kind](column(name))).alias(name) for name, (kind, agg) in states.items()]
        level, first = level.groupBy(*by).agg(*aggs), False
        if chunks == 1:
            return level


def field_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field_name, value) of every filled field of every row."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), filled(column(f)).alias("value")) for f in fields]))
    return df.select(entries.alias("e")).select("e.*").where("value is not null")


def heavy_keys(df: DataFrame, fields: list[str], share: float = 0.02, fan_in: int = FAN_IN) -> DataFrame:
    """(field_name, value, n, total) of each non-empty value that holds at least that share of all rows as stored.

    Rows with a null or empty value count in total only. An empty table gives no rows.
    """
    total = df.count()
    counts = tree_aggregate(field_values(df, fields), ["field_name", "value"], {"n": ("count", F.count(F.lit(1)))}, fan_in)
    return counts.where((F.col("n") > 0) & (F.col("n") >= F.lit(share) * F.lit(total))).withColumn("total", F.lit(total))


def usr_profile(refs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(usr, sites, callers, calls_made, callees) of every usr that refs names.

    sites: rows that refer to it; callers: different from_usr among them; calls_made: rows whose from_usr it is;
    callees: different to_usr among them. Null and empty usrs are nobody. The pairs, nearly as many as there are edges, are
    counted in one shuffle and written; each side is then a tree over the chunks of that table, so a usr with a third of
    all rows is combined where its pairs lie.
    """
    edges = refs.select(filled(F.col("to_usr")).alias("to_usr"), filled(F.col("from_usr")).alias("from_usr"))
    pairs = materialize(edges.groupBy("to_usr", "from_usr").agg(F.count(F.lit(1)).alias("n")), "pairs")

    def side(key: str, other: str, rows: str, names: str) -> DataFrame:
        states = {rows: ("sum", F.sum("n")), names: ("sum", F.count(other))}
        return tree_aggregate(pairs.where(F.col(key).isNotNull()), [key], states, fan_in).withColumnRenamed(key, "usr")

    called, calling = side("to_usr", "from_usr", "sites", "callers"), side("from_usr", "to_usr", "calls_made", "callees")
    zero = F.lit(0).cast("long")
    both = called.withColumns({"calls_made": zero, "callees": zero}).unionByName(calling.withColumns({"sites": zero, "callers": zero}))
    return both.groupBy("usr").agg(*[F.sum(c).alias(c) for c in ("sites", "callers", "calls_made", "callees")])
