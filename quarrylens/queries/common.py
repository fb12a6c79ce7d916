"""Merged tables, bindings for tables that the test data lack, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.merge import merge_refs, merge_symbols
from quarrylens.runtime import load, materialize


_stored: dict[tuple, object] = {}


def stored(spark: SparkSession, sf: str, name: str, make: Callable[[], object]) -> object:
    """What make gives, made once an application for the files of an index directory as they are now.

    Merged tables and text indexes are what an index holds; queries read them, deliveries change them.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(files)))
    key = (spark.sparkContext.applicationId, sf, name, state)
    if key not in _stored or not _there(_stored[key]):
        for old in [k for k in _stored if k[:3] == key[:3]]:
            del _stored[old]
        _stored[key] = make()
    return _stored[key]


def _there(made: object) -> bool:
    """Whether the files of a written table, or of an index's postings, are still where they were written."""
    df = made if isinstance(made, DataFrame) else made.postings
    files = df.inputFiles()
    if not files:
        return True
    first = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0])
    return first.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(first)


def sym(spark: SparkSession, sf: str) -> DataFrame:
    """The merged symbols, sorted by build and usr."""
    return stored(spark, sf, "symbols", lambda: materialize(_sorted(merge_symbols(load(spark, sf, "symbols")), "config_hash", "usr"), "merged-symbols"))


def ref(spark: SparkSession, sf: str) -> DataFrame:
    """The merged references, sorted by build and target."""
    return stored(spark, sf, "refs", lambda: materialize(_sorted(merge_refs(load(spark, sf, "refs")), "config_hash", "to_usr"), "merged-refs"))


def _sorted(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in order within each file, so that a scan for one build or name skips row groups; no further shuffle."""
    return df.sortWithinPartitions(*columns)


def inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Bound to nested types: a class derives from the class around it, virtually if the symbol is a template."""
    s = sym(spark, sf).where("kind in ('class', 'struct', 'union') and parent_usr <> ''")
    return s.select("config_hash", F.col("usr").alias("derived_usr"), F.col("parent_usr").alias("base_usr"),
                    F.when(F.col("kind") == "struct", "public").otherwise("private").alias("access"), F.col("is_template").alias("is_virtual"))


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Bound to methods of one name in a type and in the type around it."""
    s = sym(spark, sf)
    m = s.where("kind = 'method' and parent_usr <> ''").select("config_hash", "usr", "name", "parent_usr")
    t = s.where("parent_usr <> ''").select("config_hash", F.col("usr").alias("parent_usr"), F.col("parent_usr").alias("outer"))
    base = m.select("config_hash", F.col("usr").alias("base_usr"), F.col("parent_usr").alias("outer"))
    pairs = m.join(t, ["config_hash", "parent_usr"]).join(base, ["config_hash", "outer"])
    return pairs.select("config_hash", F.col("usr").alias("derived_usr"), "base_usr").distinct()


def slot_facts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Slot tables bound to references that carry a slot index: such a reference stores to_usr into a parameter of
    from_usr; a call passes the caller's first parameter on to the callee's."""
    r = ref(spark, sf).where("from_usr is not null")
    at = [F.col("from_file").alias("file"), F.col("from_line").alias("line"), F.col("from_col").alias("col")]
    s = r.where("slot_index is not null")
    slot = F.concat_ws("|", F.lit("P"), "from_usr", F.col("slot_index").cast("string"))
    entry = lambda c: F.concat(F.lit("P|"), F.col(c), F.lit("|0"))
    sources = s.select("config_hash", *at, F.col("to_usr").alias("function"), F.lit("void(int)").alias("function_type"), slot.alias("slot"), F.col("from_file").alias("unit"))
    flows = r.where("ref_kind = 'indirect'").select("config_hash", *at, entry("from_usr").alias("source"), entry("to_usr").alias("target"), F.col("from_file").alias("unit"))
    sites = r.where("ref_kind = 'indirect'").select(
        "config_hash", *at, F.lit(0).alias("ordinal"), F.col("from_usr").alias("caller"), F.lit("pointer").alias("kind"), entry("from_usr").alias("slot"),
        F.lit("void(int)").alias("slot_type"), F.lit("").alias("reason"), F.col("to_usr").alias("callee"), F.col("from_file").alias("unit"))
    return {"sources": sources, "flows": flows, "sites": sites}


SYM = """sym AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY config_hash, usr ORDER BY
coalesce(is_definition, 0) DESC, coalesce(is_weak, 0), coalesce(is_tentative, 0), seen_at, id) AS rn FROM symbols
WHERE removed_at IS NULL AND usr IS NOT NULL AND config_hash IS NOT NULL) WHERE rn = 1)"""
REF = """rf AS (SELECT config_hash, to_usr, from_file, from_line, from_col, ref_kind, nullif(coalesce(from_usr, ''), '') AS from_usr,
slot_index, min(id) AS id, bit_or(origins) AS origins, min(seen_at) AS seen_at FROM refs
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)"""
BOTH = f"{SYM},\n{REF}"
EDGES = """edges AS (SELECT DISTINCT config_hash, from_usr AS src, to_usr AS dst FROM rf
WHERE ref_kind IN ('call', 'indirect', 'implicit_construct') AND from_usr IS NOT NULL)"""
INH = """inh AS (SELECT config_hash, usr AS derived_usr, parent_usr AS base_usr, CASE WHEN kind = 'struct' THEN 'public' ELSE 'private' END AS access,
is_template AS is_virtual FROM sym WHERE kind IN ('class', 'struct', 'union') AND parent_usr <> '')"""
OVR = """ovr AS (SELECT DISTINCT m.config_hash, m.usr AS derived_usr, b.usr AS base_usr FROM sym m
JOIN sym t ON t.config_hash = m.config_hash AND t.usr = m.parent_usr AND t.parent_usr <> ''
JOIN sym b ON b.config_hash = m.config_hash AND b.parent_usr = t.parent_usr AND b.kind = 'method'
WHERE m.kind = 'method' AND m.parent_usr <> '')"""
