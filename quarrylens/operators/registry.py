"""Operators over macros, owners and rules that complete the index: macro lookup, template places, registrations, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import macro_text


def macro_lookup(macros: DataFrame, files: DataFrame, name: str, exact: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page per build of the macros of a name or prefix with their file, numbered by name, line and file."""
    hit = F.col("name") == name if exact else F.lower("name").startswith(name.lower())
    paths = files.groupBy("config_hash", F.col("id").alias("file_id")).agg(F.min("path").alias("path"))
    order = Window.partitionBy("config_hash").orderBy("name", "line", "file_id", "id")
    first = macros.where(hit).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= offset + limit).where(F.col("rn") > offset)
    return first.join(paths, ["config_hash", "file_id"], "left").withColumn("label", macro_text(F.col("name"), F.col("params"), F.col("is_function_like")))


def macro_states(macros: DataFrame, readers: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, units, states, expanded_value) of each macro over the units that read its file.

    macros: id, config_hash, path, name; readers: config_hash, path, unit; answers: config_hash, unit, name, state, value,
    params, is_function_like. states lists the different answers, most units first, then by state, value and the rest; a
    unit without an answer counts as no_answer. expanded_value is the value if all units give one and the same answer and
    it is defined: one unit that leaves the macro undefined, or says nothing, takes it away. A macro that no unit reads has
    no states.
    """
    asked = macros.select("id", "config_hash", "path", "name").join(readers.select("config_hash", "path", "unit").distinct(), ["config_hash", "path"])
    told = asked.join(answers.select("config_hash", "unit", "name", "state", "value", "params", "is_function_like").distinct(), ["config_hash", "unit", "name"], "left")
    told = told.withColumn("state", F.coalesce("state", F.lit("no_answer")))
    counted = told.groupBy("id", "state", "value", "params", "is_function_like").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct((-F.col("n")).alias("m"), "state", "value", "params", "is_function_like")
    per = counted.groupBy("id").agg(F.sum("n").alias("units"), F.sort_array(F.collect_list(one)).alias("s"))
    sole = (F.size("s") == 1) & (F.col("s")[0]["state"] == "defined")
    states = F.transform("s", lambda r: F.concat_ws(" ", (-r["m"]).cast("string"), r["state"], r["value"]))
    return macros.select("id").join(per.select("id", "units", states.alias("states"), F.when(sole, F.col("s")[0]["value"]).alias("expanded_value")), "id", "left").select(
        "id", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("states", F.array().cast("array<string>")).alias("states"), "expanded_value")


def template_places(instances: DataFrame, merged: DataFrame) -> DataFrame:
    """(config_hash, template_usr, place): the place of a template that has one place, or whose places are merged."""
    places = instances.groupBy("config_hash", "template_usr").agg(F.countDistinct("file_path", "line").alias("n"), F.min(F.struct("file_path", "line")).alias("p"))
    ok = merged.select("config_hash", "template_usr").distinct().withColumn("m", F.lit(True))
    return places.join(ok, ["config_hash", "template_usr"], "left").where("n = 1 or m").select("config_hash", "template_usr", F.concat_ws(":", "p.file_path", F.col("p.line").cast("string")).alias("place"))


def runtime_registrations(calls: DataFrame, values: DataFrame, offset: int = 0) -> DataFrame:
    """(config_hash, slot_index, handler): registration calls (config_hash, macro, handler) whose macro has one agreed value."""
    agreed = values.groupBy("config_hash", "macro").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo = hi")
    return calls.join(agreed, ["config_hash", "macro"]).select("config_hash", (F.col("lo") + offset).cast("int").alias("slot_index"), "handler").distinct()


def sdk_entries(edges: DataFrame, links: DataFrame, slots: DataFrame) -> DataFrame:
    """(config_hash, from_usr, to_usr, entries): the rules' entries that explain an edge, by call link and by slot target."""
    by_call = edges.join(links.where("kind = 'call'").select("config_hash", F.col("entry").alias("from_usr"), "sdk"), ["config_hash", "from_usr"])
    by_slot = edges.join(slots.select("config_hash", F.col("function").alias("to_usr"), "slot"), ["config_hash", "to_usr"]).join(links.select("config_hash", "slot", "sdk"), ["config_hash", "slot"])
    both = by_call.select("config_hash", "from_usr", "to_usr", "sdk").union(by_slot.select("config_hash", "from_usr", "to_usr", "sdk")).distinct()
    return both.groupBy("config_hash", "from_usr", "to_usr").agg(F.array_join(F.sort_array(F.collect_list("sdk")), "; ").alias("entries"))


def sample_terms(hits: DataFrame, by: str, tokens: str, noise: float = 0.2, top: int = 10) -> DataFrame:
    """(by, term, n, rank): the words of found rows (by, tokens as text) that come most often; words in more than the
    noise share of a query's rows say nothing."""
    size = hits.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    counts = hits.select(by, F.explode(F.array_distinct(F.split(tokens, " "))).alias("term")).where("term <> ''").groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.join(size, by).where(F.col("n") <= F.greatest(F.col("rows") * noise, F.lit(1)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= top).select(by, "term", "n", "rank")


def run_phases(state: dict, phases: list[tuple[str, Callable[[dict], dict]]]) -> dict:
    """Run named phases in order over a state; a phase that fails is noted under warnings and the others go on."""
    state = {**state, "warnings": []}
    for name, phase in phases:
        try:
            state = {**state, **phase(state)}
        except Exception as e:  # noqa: BLE001
            state["warnings"].append(f"{name}: {e}")
    return state
