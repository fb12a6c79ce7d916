"""References to records that do not exist.

References and parent keys are partitioned alike and sorted by key, and both streams are merged in one pass (Spark's
sort-merge join, asked for by hint). A parent key comes with its validity interval, from the first time that it was
seen until it was removed for good, so one comparison tells missing, late and deleted references apart. The parent keys
are written first, so that the join reads two shuffles and nothing else: adaptive execution then splits a key that
holds a large part of the references, as its parent is one row, which every part gets. What is left of the references, the
orphans, is combined by reference afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import column, filled, materialize

STATES = ("missing", "late", "deleted")


def validity(parents: DataFrame, keys: list[str], seen: str, removed: str) -> DataFrame:
    """One row per key: born, the smallest seen; gone, the largest removed if all rows have one, else null.

    Rows of a key that only have null times are held as born never: no reference to them is late.
    """
    return (
        parents.where(" and ".join(f"`{k}` is not null" for k in keys))
        .groupBy(*[column(k).alias(f"k{i}") for i, k in enumerate(keys)])
        .agg(
            F.min(column(seen)).alias("born"),
            F.when(F.count(F.lit(1)) == F.count(column(removed)), F.max(column(removed))).alias("gone"),
        )
    )


def orphan_references(
    refs: DataFrame, parents: DataFrame, group: str = "config_hash", sides: dict[str, str] | None = None,
    key: str = "usr", ref_id: str = "id", seen: str = "seen_at", removed: str = "removed_at",
) -> DataFrame:
    """(ref_id, group, side, key, state, seen_at) of each reference whose parent is missing, late or deleted.

    sides names the referring columns, by default to: to_usr and from: from_usr. A null or empty reference is none.
    Keys compare exactly, within one group. missing: no parent row; late: seen before the parent's first row; deleted:
    seen at or after the last removal of a parent all of whose rows are removed. A null seen time is neither late nor
    deleted, a null group never has a parent. A reference row delivered twice gives one row. Empty references give an
    empty result, empty parents make every reference missing.
    """
    sides = sides or {"to": "to_usr", "from": "from_usr"}
    entry = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), filled(column(c)).alias("k")) for s, c in sides.items()]))
    stream = (
        refs.select(column(ref_id).alias("ref_id"), column(group).alias("k0"), column(seen).alias("seen_at"), entry.alias("e"))
        .select("ref_id", "k0", "seen_at", F.col("e.side").alias("side"), F.col("e.k").alias("k1"))
        .where("k1 is not null")
    )
    keys = materialize(validity(parents, [group, key], seen, removed), "parent-keys").withColumn("held", F.lit(True))
    state = (
        F.when(F.col("held").isNull(), "missing")
        .when(F.col("seen_at") < F.col("born"), "late")
        .when(F.col("seen_at") >= F.col("gone"), "deleted")
    )
    merged = stream.hint("merge").join(keys, ["k0", "k1"], "left").withColumn("state", state).where("state is not null")
    # grouped by a hash of the key, not the key: a partitioning that the join's own one can't serve leaves it free to be split
    once = merged.groupBy("ref_id", "side", "state", "seen_at", F.xxhash64("k0", "k1").alias("k")).agg(F.any_value("k0").alias("k0"), F.any_value("k1").alias("k1"))
    return once.select("ref_id", F.col("k0").alias(group), "side", F.col("k1").alias(key), "state", "seen_at")


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Orphans per table, side, state and month of the reference; a null time has a null month."""
    month = F.date_format("seen_at", "yyyy-MM")
    return orphans.groupBy(F.lit(table).alias("table_name"), "side", "state", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n_refs")
    )
