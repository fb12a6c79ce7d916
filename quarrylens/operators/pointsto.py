"""Points-to resolution of indirect calls as fix points.

Facts: sources (a function stored into a slot), flows (a slot copied into another), sites (a call through a slot),
arguments (what a site passes), overrides, escapes. The inner fix point carries functions along flows; the outer one
passes arguments into the parameters of newly found targets. No fact leaves its build: the facts of each come together
once and are solved there (solve.py), into sets of functions that are only written out as rows when they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.callgraph import walk
from quarrylens.operators.solve import FACT, SOLVED, solve
from quarrylens.runtime import materialize, ship

_SITE = ("config_hash", "file", "line", "col", "ordinal")


def reach(flows: DataFrame, start: DataFrame) -> DataFrame:
    """(config_hash, target, usr, depth): the slots that each start slot flows into, without a bound of depth."""
    edges = flows.select("config_hash", F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()
    return walk(edges, start.select("config_hash", F.col("slot").alias("usr")), None)


def override_flows(overrides: DataFrame, slots: DataFrame) -> DataFrame:
    """Flows between the parameters of a base method and its override, and from the override's return value to the base's."""
    index = slots.where("slot like 'P|%'").select("config_hash", F.regexp_extract("slot", r"^P\|(.*)\|[^|]*$", 1).alias("code"), F.substring_index("slot", "|", -1).alias("i")).distinct()
    pairs = overrides.select("config_hash", "base_usr", "derived_usr").distinct()
    by_base = pairs.join(index.withColumnRenamed("code", "base_usr"), ["config_hash", "base_usr"])
    by_derived = pairs.join(index.withColumnRenamed("code", "derived_usr"), ["config_hash", "derived_usr"])
    params = by_base.unionByName(by_derived, allowMissingColumns=True).distinct().select(
        "config_hash", F.concat_ws("|", F.lit("P"), "base_usr", "i").alias("source"), F.concat_ws("|", F.lit("P"), "derived_usr", "i").alias("target"))
    returns = pairs.select("config_hash", F.concat(F.lit("R|"), "derived_usr").alias("source"), F.concat(F.lit("R|"), "base_usr").alias("target"))
    return params.unionByName(returns)


@dataclass
class Resolution:
    """targets (slot, function), via (slot, function, via), escaped (slot) and edges (site, function, type_only)."""

    targets: DataFrame
    via: DataFrame
    escaped: DataFrame
    edges: DataFrame


def resolve_slots(
    sources: DataFrame, flows: DataFrame, sites: DataFrame, arguments: DataFrame | None = None, overrides: DataFrame | None = None,
    escapes: DataFrame | None = None, defined: DataFrame | None = None,
) -> Resolution:
    """The functions that each call site may call.

    A site calls the functions in its slot and its named callee. A pointer site without a slot, or with an escaped one,
    may also call every function of its type (type only). The arguments of a site go into the parameters of its targets;
    those of type-only targets escape. An escape for unseen code (reason outside) doesn't count if the build defines
    what the slot names. An address site calls nothing. Lambdas and functions without a type are never guessed by type.
    """
    spark = sources.sparkSession
    ship(spark)
    direct = sources.select("config_hash", "slot", "function")
    flows = flows.select("config_hash", "source", "target")
    sites = sites.select(*_SITE, "caller", "kind", F.coalesce("slot", F.lit("")).alias("slot"), "slot_type", "callee").where("kind <> 'address'")
    if overrides is not None:
        named = sources.select("config_hash", "slot").union(flows.select("config_hash", "source")).union(flows.select("config_hash", "target")).union(sites.select("config_hash", "slot"))
        flows = flows.unionByName(override_flows(overrides, named))
    by_type = sources.where("function_type not in ('', 'lambda')").select("config_hash", F.col("function_type").alias("slot_type"), "function")
    pointer_type = F.when(F.col("kind") == "pointer", F.col("slot_type"))
    facts = [
        direct.select("config_hash", F.lit("source").alias("fact"), F.col("slot").alias("a"), F.col("function").alias("b")),
        flows.where("source <> target").select("config_hash", F.lit("flow").alias("fact"), F.col("source").alias("a"), F.col("target").alias("b")),
        by_type.select("config_hash", F.lit("type").alias("fact"), F.col("slot_type").alias("a"), F.col("function").alias("b")),
        sites.select(*_SITE, F.lit("site").alias("fact"), F.col("slot").alias("a"), pointer_type.alias("b"), F.col("callee").alias("c")),
    ]
    if escapes is not None:
        lost = escapes
        if defined is not None:
            code = F.expr("substring(slot, instr(slot, '|') + 1)")
            lost = lost.withColumn("usr", code).join(defined.select("config_hash", "usr").withColumn("d", F.lit(True)).distinct(), ["config_hash", "usr"], "left").where("reason <> 'outside' or d is null")
        facts.append(lost.select("config_hash", F.lit("escape").alias("fact"), F.col("slot").alias("a")))
    args = None
    if arguments is not None:
        args = arguments.select(*_SITE, F.col("arg_index").cast("string").alias("arg_index"), "value_kind", "value")
        facts.append(args.select(*_SITE, F.lit("argument").alias("fact"), F.col("arg_index").alias("a"), F.col("value_kind").alias("b"), F.col("value").alias("c")))
    every = facts[-1]
    for f in facts[:-1]:
        every = every.unionByName(f, allowMissingColumns=True)
    where = ", ".join(f"{c}: {sites.schema[c].dataType.simpleString()}" for c in _SITE[1:])
    parts = 4 * spark.sparkContext.defaultParallelism
    solved = every.select(*FACT, *_SITE[1:]).repartition(parts, "config_hash").sortWithinPartitions("config_hash").mapInArrow(solve, f"{SOLVED}, places array<struct<{where}>>")
    solved = materialize(solved.repartition(parts, "config_hash", "n"), "pt-solved")
    part = lambda name: solved.where(F.col("part") == name)
    place = solved.select("config_hash", F.explode("places").alias("at"), "functions", (F.col("part") == "guess").alias("type_only"))
    edges = place.select("config_hash", *(F.col(f"at.{c}").alias(c) for c in _SITE[1:]), F.explode("functions").alias("function"), "type_only")
    targets = part("target").select("config_hash", "slot", F.explode("functions").alias("function"))
    escaped = part("escaped").select("config_hash", "slot")
    if args is not None:
        given = edges.where("not type_only").join(args, list(_SITE)).withColumn("param", F.concat_ws("|", F.lit("P"), "function", "arg_index"))
        direct = direct.unionByName(given.where("value_kind = 'function'").select("config_hash", F.col("param").alias("slot"), F.col("value").alias("function")))
        flows = flows.unionByName(given.where("value_kind <> 'function'").select("config_hash", F.col("value").alias("source"), F.col("param").alias("target")))
    given_on = flows.where("source <> target").join(targets.withColumnRenamed("slot", "source"), ["config_hash", "source"]).select(
        "config_hash", F.col("target").alias("slot"), "function", F.col("source").alias("via"))
    via = direct.withColumn("via", F.lit("")).unionByName(given_on).distinct()
    return Resolution(targets, via, escaped, edges)


def site_counts(sites: DataFrame) -> DataFrame:
    """(config_hash, slot, sites, callers): the call sites of each slot, copies in several units counted once, and who holds them."""
    return sites.drop("unit").distinct().groupBy("config_hash", "slot").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("caller").alias("callers"))


def call_refs(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Reference rows of resolved edges: indirect, with the slot bit, or the type-only bit; copies of a template's site count once."""
    from quarrylens.operators.references import one_unit_sites

    content = [c for c in (*_SITE, "caller", "kind", "slot", "slot_type") if c in sites.columns]
    once = one_unit_sites(sites, content)
    return once.join(edges, list(_SITE)).select(
        "config_hash", F.col("function").alias("to_usr"), F.col("file").alias("from_file"), F.col("line").alias("from_line"), F.col("caller").alias("from_usr"),
        F.lit("indirect").alias("ref_kind"), F.col("col").alias("from_col"), F.when(F.col("type_only"), 64).otherwise(32).alias("origins")).distinct()


def stored_places(via: DataFrame, sources: DataFrame, wanted: DataFrame, max_slots: int = 256) -> DataFrame:
    """(config_hash, start_slot, function, file, line): where the code stored each function that a wanted slot holds,
    followed back through the slots that gave it; capped is set where a function has more than max_slots of them."""
    back = via.where("via <> ''").select("config_hash", F.concat_ws("\x1f", "slot", "function").alias("src"), F.concat_ws("\x1f", "via", "function").alias("dst")).distinct()
    own = via.join(wanted.select("config_hash", "slot").distinct(), ["config_hash", "slot"], "left_semi").select("config_hash", F.concat_ws("\x1f", "slot", "function").alias("usr")).distinct()
    far = walk(back, own, None).select("config_hash", F.col("target").alias("start"), "usr")
    all_slots = far.unionByName(own.select("config_hash", F.col("usr").alias("start"), "usr")).distinct()
    sized = all_slots.groupBy("config_hash", "start").agg(F.count(F.lit(1)).alias("n"))
    split = lambda c, i: F.split(c, "\x1f")[i]
    placed = all_slots.join(sized, ["config_hash", "start"]).select("config_hash", split(F.col("start"), 0).alias("start_slot"), split(F.col("usr"), 0).alias("slot"), split(F.col("usr"), 1).alias("function"), (F.col("n") > max_slots).alias("capped"))
    return placed.join(sources.select("config_hash", "slot", "function", "file", "line"), ["config_hash", "slot", "function"]).select("config_hash", "start_slot", "function", "file", "line", "capped").distinct()


def vector_table(refs: DataFrame, symbols: DataFrame, dispatchers: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """(config_hash, from_file, slot_index, to_usr, status): the entries of interrupt tables.

    In this order: linker (undefined or ld: symbol), data (vector_data), dispatcher (fills more than one slot of its
    table and calls through a pointer) or c for other code, unhandled for an assembler alias, dispatcher or assembly.
    An unhandled slot that a registration fills is runtime.
    """
    entries = refs.where(F.col("ref_kind").isin("vector", "vector_data") & F.col("slot_index").isNotNull()).select("config_hash", "from_file", "slot_index", "to_usr", "ref_kind").distinct()
    filled = F.count(F.lit(1)).over(Window.partitionBy("config_hash", "from_file", "to_usr"))
    aliases = refs.where("ref_kind = 'alias'").select("config_hash", F.col("from_usr").alias("to_usr")).where("to_usr is not null").distinct().withColumn("alias", F.lit(True))
    calls = dispatchers.select("config_hash", F.col("usr").alias("to_usr")).distinct().withColumn("disp", F.lit(True))
    kinds = symbols.select("config_hash", F.col("usr").alias("to_usr"), "kind")
    t = entries.withColumn("slots", filled).join(kinds, ["config_hash", "to_usr"], "left").join(aliases, ["config_hash", "to_usr"], "left").join(calls, ["config_hash", "to_usr"], "left")
    asm, many = F.col("to_usr").startswith("asm:"), (F.col("slots") > 1) & F.coalesce("disp", F.lit(False))
    status = (
        F.when((F.col("kind") == "undefined") | F.col("to_usr").startswith("ld:"), "linker").when(F.col("ref_kind") == "vector_data", "data")
        .when(~asm & many, "dispatcher").when(~asm, "c").when(F.coalesce("alias", F.lit(False)), "unhandled").when(many, "dispatcher").otherwise("assembly")
    )
    t = t.withColumn("status", status)
    if registrations is not None:
        t = t.join(registrations.select("config_hash", "slot_index").distinct().withColumn("reg", F.lit(True)), ["config_hash", "slot_index"], "left")
        t = t.withColumn("status", F.when((F.col("status") == "unhandled") & F.coalesce("reg", F.lit(False)), "runtime").otherwise(F.col("status")))
    return t.select("config_hash", "from_file", "slot_index", "to_usr", "status")


def unify_internal(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(config_hash, alias, usr): prototypes of static functions that stand for one definition.

    aliases: config_hash, alias, name, decl_file, line, signature. Only where the alias has one place, one definition of
    that name stands in that file, the alias itself has no definition and the signatures agree.
    """
    single = aliases.groupBy("config_hash", "alias").agg(F.countDistinct("decl_file", "line").alias("places"), F.min("decl_file").alias("file_path"), F.min("name").alias("name"), F.min("signature").alias("lo"), F.max("signature").alias("hi")).where("places = 1 and lo = hi")
    defs = symbols.where("is_definition = 1").groupBy("config_hash", "file_path", "name").agg(F.min("usr").alias("usr"), F.max("usr").alias("other"), F.min("signature").alias("signature")).where("usr = other")
    known = symbols.where("is_definition = 1").select("config_hash", F.col("usr").alias("alias"))
    return single.join(defs, ["config_hash", "file_path", "name"]).where("signature = lo").join(known, ["config_hash", "alias"], "left_anti").select("config_hash", "alias", "usr")


def rename(table: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """table with the aliases in these columns replaced by their symbols."""
    for c in columns:
        m = aliases.select("config_hash", F.col("alias").alias(c), F.col("usr").alias("__to"))
        table = table.join(m, ["config_hash", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return table


def sdk_links(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """Links that rules (entry_name, kind, slot_index, callee_name, sdk) give for symbols of those names."""
    entry = symbols.select("config_hash", F.col("usr").alias("entry"), F.col("name").alias("entry_name"), F.col("file_path").alias("file"), "line")
    callee = symbols.select("config_hash", F.col("usr").alias("target"), F.col("name").alias("callee_name"))
    slot = F.concat_ws("|", F.lit("P"), "entry", F.col("slot_index").cast("string")).alias("slot")
    return entry.join(rules, "entry_name").join(callee, ["config_hash", "callee_name"], "left").select("config_hash", "kind", slot, "target", "entry", "sdk", "file", "line")


def sdk_edges(links: DataFrame, targets: DataFrame, flows: DataFrame, known: DataFrame) -> DataFrame:
    """(config_hash, from_usr, to_usr): targets of call links from their entries.

    A link whose slot flows on into an inner link's slot gives none, unless that one flows back; nor does a call that
    the code makes itself.
    """
    calls = links.where("kind = 'call'").select("config_hash", "slot", "entry").distinct()
    far = reach(flows, calls.select("config_hash", "slot").distinct()).select("config_hash", F.col("target").alias("slot"), F.col("usr").alias("other")).where("slot <> other")
    inner = far.join(calls.select("config_hash", F.col("slot").alias("other")).distinct(), ["config_hash", "other"], "left_semi")
    back = inner.select("config_hash", F.col("slot").alias("other"), F.col("other").alias("slot"))
    outer = inner.join(back, ["config_hash", "slot", "other"], "left_anti").select("config_hash", "slot").distinct()
    run = calls.join(outer, ["config_hash", "slot"], "left_anti").join(targets, ["config_hash", "slot"]).select("config_hash", F.col("entry").alias("from_usr"), F.col("function").alias("to_usr")).distinct()
    return run.join(known.select("config_hash", "from_usr", "to_usr").distinct(), ["config_hash", "from_usr", "to_usr"], "left_anti")
