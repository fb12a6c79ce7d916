"""Joins between references and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import CALL_EDGES, member_range, scope_name

_SYM = ("usr", "name", "qualified_name", "kind", "file_path")


def as_side(symbols: DataFrame, prefix: str, key: str) -> DataFrame:
    """Symbols renamed for a join on key; only the columns that answers show."""
    return symbols.select("config_hash", F.col("usr").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in _SYM[1:]])


def refs_of(refs: DataFrame, symbols: DataFrame, usr: str) -> DataFrame:
    """References to one usr beside the caller's symbol, null at file scope."""
    return refs.where(F.col("to_usr") == usr).join(as_side(symbols, "caller", "from_usr"), ["config_hash", "from_usr"], "left")


def refs_of_type(refs: DataFrame, symbols: DataFrame, usr: str) -> DataFrame:
    """References to any member of a type, one row per caller, file and line with the bits of all."""
    own = refs.where((F.col("to_usr") == usr) | member_range(F.col("to_usr"), usr))
    with_caller = own.join(as_side(symbols, "caller", "from_usr"), ["config_hash", "from_usr"], "left")
    return with_caller.groupBy("config_hash", "caller_qualified_name", "from_file", "from_line").agg(
        F.min("from_col").alias("from_col"), F.bit_or("origins").alias("origins")
    )


def callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(config_hash, usr, from_usr, sites): callers of every symbol over call edges; sites are combined before the join."""
    edges = refs.where(F.col("ref_kind").isin(*CALL_EDGES) & F.col("from_usr").isNotNull()).groupBy("config_hash", "to_usr", "from_usr").agg(F.count(F.lit(1)).alias("sites"))
    return edges.join(as_side(symbols, "caller", "from_usr"), ["config_hash", "from_usr"])


def callees(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (from_usr, to_usr, ref_kind) over call and indirect edges with the callee's symbol."""
    edges = refs.where(F.col("ref_kind").isin("call", "indirect") & F.col("from_usr").isNotNull()).select("config_hash", "from_usr", "to_usr", "ref_kind").distinct()
    return edges.join(as_side(symbols, "callee", "to_usr"), ["config_hash", "to_usr"])


def refs_round_robin(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """References of several candidates (usr, pos) interleaved by depth: rn within a candidate, then its position."""
    order = Window.partitionBy("config_hash", "to_usr").orderBy("from_file", "from_line", "from_col", "id")
    own = refs.join(candidates.withColumnRenamed("usr", "to_usr"), ["config_hash", "to_usr"])
    return own.withColumn("rn", F.row_number().over(order))


def refs_capped(refs: DataFrame, cap: int = 30) -> DataFrame:
    """The first references of each symbol beside their true number.

    The number is counted apart, with map-side combining; the ranking keeps cap rows per key and task (a window group
    limit), so a hot symbol costs no long sort.
    """
    totals = refs.groupBy("config_hash", "to_usr").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("config_hash", "to_usr").orderBy("from_file", "from_line", "from_col", "id")
    return refs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).join(totals, ["config_hash", "to_usr"])


def one_unit_sites(sites: DataFrame, content: list[str], unit: str = "unit") -> DataFrame:
    """Copies of a template's site in several units, reduced to the first unit; null equals null."""
    return sites.groupBy(*content).agg(F.min(unit).alias(unit))


def site_targets(sites: DataFrame, refs: DataFrame, mask: int) -> DataFrame:
    """Call sites beside the edges with one of the mask's bits at the same place and caller, null-safe."""
    edges = refs.where(F.col("origins").bitwiseAND(mask) != 0).select("config_hash", F.col("from_file").alias("file"), F.col("from_line").alias("line"), F.col("from_col").alias("col"), F.col("from_usr").alias("r_caller"), "to_usr")
    return sites.join(edges, ["config_hash", "file", "line", "col"]).where(F.col("caller").eqNullSafe(F.col("r_caller"))).drop("r_caller")


def overrides_both_ways(overrides: DataFrame, symbols: DataFrame) -> DataFrame:
    """(config_hash, usr, direction, other_usr, names): what a method overrides and what overrides it."""
    up = overrides.select("config_hash", F.col("derived_usr").alias("usr"), F.lit("overrides").alias("direction"), F.col("base_usr").alias("other_usr"))
    down = overrides.select("config_hash", F.col("base_usr").alias("usr"), F.lit("overridden_by").alias("direction"), F.col("derived_usr").alias("other_usr"))
    return up.unionByName(down).join(as_side(symbols, "other", "other_usr"), ["config_hash", "other_usr"], "left")


def direct_relatives(inheritance: DataFrame, types: DataFrame) -> DataFrame:
    """(config_hash, usr, direction, other_usr, access, is_virtual): the direct bases of many types and what derives from them."""
    up = inheritance.select("config_hash", F.col("derived_usr").alias("usr"), F.lit("base").alias("direction"), F.col("base_usr").alias("other_usr"), "access", "is_virtual")
    down = inheritance.select("config_hash", F.col("base_usr").alias("usr"), F.lit("derived").alias("direction"), F.col("derived_usr").alias("other_usr"), "access", "is_virtual")
    return up.unionByName(down).join(types.select("config_hash", "usr").distinct(), ["config_hash", "usr"], "left_semi")


def virtual_callers(overrides: DataFrame, refs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(config_hash, usr, from_usr): callers recorded on the base of a method or on its sibling overrides.

    With symbols, a method or destructor that overrides nothing has for siblings the virtual ones of its name in its class.
    """
    bases = overrides.groupBy("config_hash", F.col("derived_usr").alias("usr")).agg(F.min("base_usr").alias("base_usr"))
    siblings = bases.join(overrides.select("config_hash", "base_usr", F.col("derived_usr").alias("to_usr")), ["config_hash", "base_usr"]).select("config_hash", "usr", "to_usr")
    family = siblings.unionByName(bases.select("config_hash", "usr", F.col("base_usr").alias("to_usr"))).where("to_usr <> usr").distinct()
    if symbols is not None:
        m = symbols.where("kind in ('method', 'destructor') and parent_usr <> ''").select("config_hash", "parent_usr", "name", "usr", ((F.col("is_virtual") == 1) | (F.col("is_pure_virtual") == 1)).alias("v"))
        alone = m.drop("v").join(bases.select("config_hash", "usr"), ["config_hash", "usr"], "left_anti")
        same = alone.join(m.where("v").select("config_hash", "parent_usr", "name", F.col("usr").alias("to_usr")), ["config_hash", "parent_usr", "name"]).where("to_usr <> usr")
        family = family.unionByName(same.select("config_hash", "usr", "to_usr"))
    calls = refs.where(F.col("ref_kind").isin(*CALL_EDGES) & F.col("from_usr").isNotNull()).select("config_hash", "to_usr", "from_usr").distinct()
    return family.join(calls, ["config_hash", "to_usr"]).select("config_hash", "usr", "from_usr").distinct()


def wrapper_callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(config_hash, class_usr, wrapper, sites, methods): calls into the methods of a class by the scope of the caller."""
    methods = symbols.where(F.col("kind").isin("method", "constructor", "destructor") & (F.coalesce("parent_usr", F.lit("")) != "")).select("config_hash", F.col("usr").alias("to_usr"), F.col("parent_usr").alias("class_usr"))
    calls = refs.where(F.col("ref_kind").isin(*CALL_EDGES)).groupBy("config_hash", "to_usr", "from_usr").agg(F.count(F.lit(1)).alias("n"))
    scope = symbols.select("config_hash", F.col("usr").alias("from_usr"), scope_name(F.col("qualified_name")).alias("wrapper"))
    joined = calls.join(methods, ["config_hash", "to_usr"]).join(scope, ["config_hash", "from_usr"])
    return joined.groupBy("config_hash", "class_usr", "wrapper").agg(F.sum("n").alias("sites"), F.countDistinct("to_usr").alias("methods"))


def follow_declarations(edges: DataFrame, symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges whose target is a declaration redirected to the definition of its link name."""
    declared = symbols.where("is_definition = 0 and link_name <> ''").select("config_hash", F.col("usr").alias("to_usr"), "link_name")
    named = declared.join(definitions.select("config_hash", "link_name", F.col("usr").alias("def_usr")), ["config_hash", "link_name"]).select("config_hash", "to_usr", "def_usr")
    return edges.join(named, ["config_hash", "to_usr"], "left").withColumn("to_usr", F.coalesce("def_usr", "to_usr")).drop("def_usr")
