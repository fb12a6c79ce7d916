"""Merge, upsert and maintenance as recomputation: the merged table is a function of all delivered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ("config_hash", "to_usr", "from_file", "from_line", "from_col", "ref_kind")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order. One aggregate with map-side combining, so a hot key costs no long sort."""
    rest = [c for c in df.columns if c not in keys]
    named = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), named).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def merge_symbols(symbols: DataFrame, fresh_files: DataFrame | None = None) -> DataFrame:
    """One row per (config_hash, usr) of the rows that aren't removed.

    A definition replaces a declaration, a strong one a weak one, a real one a tentative one; otherwise the first row
    seen holds, of equal times the smaller id. fresh_files (config_hash, file_path, since) names files that were read anew:
    a row of theirs that was seen before that is stale, and any other row replaces it.
    """
    live = symbols.where("removed_at is null and usr is not null and config_hash is not null")
    stale = F.lit(False)
    if fresh_files is not None:
        since = fresh_files.groupBy("config_hash", "file_path").agg(F.max("since").alias("__since"))
        live = live.join(since, ["config_hash", "file_path"], "left")
        stale = F.coalesce(F.col("seen_at") < F.col("__since"), F.lit(False))
    order = [stale, -F.coalesce("is_definition", F.lit(0)), F.coalesce("is_weak", F.lit(0)), F.coalesce("is_tentative", F.lit(0)), F.col("seen_at"), F.col("id")]
    best = first_by(live, ["config_hash", "usr"], order)
    return best if fresh_files is None else best.drop("__since").select(*symbols.columns)


def merge_refs(refs: DataFrame) -> DataFrame:
    """One row per reference site with the bits of all its deliveries; null and empty from_usr and null slots are equal."""
    from_usr, slot = F.coalesce("from_usr", F.lit("")), F.coalesce("slot_index", F.lit(-1))
    merged = refs.groupBy(*SITE, from_usr.alias("from_usr"), slot.alias("slot_index")).agg(
        F.min("id").alias("id"), F.bit_or("origins").alias("origins"), F.min("seen_at").alias("seen_at")
    )
    return merged.withColumns({
        "from_usr": F.when(F.col("from_usr") != "", F.col("from_usr")), "slot_index": F.when(F.col("slot_index") >= 0, F.col("slot_index")),
    })


def release_producers(refs: DataFrame, producers: DataFrame, instantiation_bit: int = 16) -> DataFrame:
    """References that no unit produces any more lose the instantiation bit and go when no bit is left."""
    held = producers.select(F.col("ref_id").alias("id")).distinct().withColumn("held", F.lit(True))
    bits = F.when(F.col("held").isNull(), F.col("origins").bitwiseAND(~instantiation_bit)).otherwise(F.col("origins"))
    return refs.join(held, "id", "left").withColumn("origins", bits).where("origins <> 0").drop("held")


def cache_put(old: DataFrame, new: DataFrame, key: str, overwrite: bool = False, order: str | None = None) -> DataFrame:
    """Content-addressed cache: the first write of a key wins, or with overwrite the last."""
    stamped = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    rank = -F.col("__gen") if overwrite else F.col("__gen")
    return first_by(stamped, [key], [rank, F.col(order) if order else F.lit(0)]).drop("__gen")


def cache_get(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The wanted keys with their cached values, null where there is none."""
    return wanted.join(cache, key, "left")


def replace_files(table: DataFrame, fresh: DataFrame, file_keys: list[str]) -> DataFrame:
    """All rows of the files that fresh has, replaced by fresh's."""
    return table.join(fresh.select(*file_keys).distinct(), file_keys, "left_anti").unionByName(fresh)


def delete_files(symbols: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and references without those of the files (config_hash, path), nor references to symbols that went."""
    keys = gone.select("config_hash", F.col("path").alias("file_path")).distinct()
    lost = symbols.join(keys, ["config_hash", "file_path"], "left_semi").select("config_hash", "usr").distinct()
    kept = symbols.join(keys, ["config_hash", "file_path"], "left_anti")
    lost = lost.join(kept.select("config_hash", "usr"), ["config_hash", "usr"], "left_anti")
    left = refs.join(keys.withColumnRenamed("file_path", "from_file"), ["config_hash", "from_file"], "left_anti")
    return kept, left.join(lost.withColumnRenamed("usr", "to_usr"), ["config_hash", "to_usr"], "left_anti")


def orphan_files(files: DataFrame, symbols: DataFrame, macros: DataFrame | None = None) -> DataFrame:
    """Files without symbols, macros and content."""
    keys = ["config_hash", "file_id"]
    left = files.where("coalesce(content_hash, '') = ''").withColumnRenamed("id", "file_id").join(symbols.select(*keys).distinct(), keys, "left_anti")
    if macros is not None:
        left = left.join(macros.select(*keys).distinct(), keys, "left_anti")
    return left.withColumnRenamed("file_id", "id")


def delete_build(tables: dict[str, DataFrame], config_hash: str) -> dict[str, DataFrame]:
    return {n: t.where(F.col("config_hash") != config_hash) if "config_hash" in t.columns else t for n, t in tables.items()}


def builds_of_scope(builds: DataFrame, runs: DataFrame, project_id: str | None = None, variant: str | None = None, image: str | None = None) -> DataFrame:
    """The builds of a project, variant and image (None: any) that ended a run well, newest first: rn by created_at, then config_hash."""
    own = builds.join(runs.where("state = 'ok'").select("config_hash").distinct(), "config_hash", "left_semi")
    for name, value in (("project_id", project_id), ("variant", variant), ("image", image)):
        own = own if value is None else own.where(F.col(name) == value)
    return own.withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("config_hash"))))


def latest_builds(builds: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The newest build per project, variant and image; builds that never ended a run well don't count."""
    if runs is not None:
        builds = builds.join(runs.where("state = 'ok'").select("config_hash").distinct(), "config_hash", "left_semi")
    newest = Window.partitionBy("project_id", "variant", "image").orderBy(F.desc("created_at"), F.desc("config_hash"))
    return builds.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")


def header_owners(claims: DataFrame) -> DataFrame:
    """(config_hash, header, unit): C++ units claim first, then by path and flags."""
    order = F.struct((F.col("language") != "cpp").alias("o"), "unit_path", "flags_hash")
    return claims.groupBy("config_hash", "header").agg(F.min_by(F.col("unit_path"), order).alias("unit"))


def decide_units(current: DataFrame, manifest: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """(keys, decision): new, gone, changed or unchanged; one changed listing of a key makes it changed.

    A null or empty hash equals nothing.
    """
    side = lambda df, tag: df.groupBy(*keys).agg(F.collect_set(F.struct(*hashes)).alias(tag), F.max(reduce(lambda a, b: a | b, [F.coalesce(F.col(h), F.lit("")) == "" for h in hashes])).alias(f"{tag}_open"))
    both = side(current, "now").join(side(manifest, "was"), keys, "full")
    same = (F.array_sort("now") == F.array_sort("was")) & ~F.col("now_open") & ~F.col("was_open")
    decision = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return both.select(*keys, decision.alias("decision"))


def run_pairs(runs: DataFrame) -> DataFrame:
    """(config_hash, run_no, last_run): each run that ended well beside the last earlier one of its build, null for the first."""
    ok = runs.where("state = 'ok'").select("config_hash", "run_no").distinct()
    return ok.withColumn("last_run", F.lag("run_no").over(Window.partitionBy("config_hash").orderBy("run_no")))


def against_last(files: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listings of every run that ended well, and those of its last earlier such run, both under the run's number."""
    pairs = run_pairs(runs)
    now = files.join(pairs.select("config_hash", "run_no"), ["config_hash", "run_no"])
    was = files.withColumnRenamed("run_no", "last_run").join(pairs.where("last_run is not null"), ["config_hash", "last_run"]).drop("last_run")
    return now, was


def modified_files(current: DataFrame, stored: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """Files whose content hash differs between two listings, with the side that lacks it as null."""
    a, b = current.select(*keys, F.col(hash_col).alias("now")).distinct(), stored.select(*keys, F.col(hash_col).alias("was")).distinct()
    return a.join(b, keys, "full").where(~F.col("now").eqNullSafe(F.col("was")))


def annotate_stale(rows: DataFrame, stale_files: DataFrame, path: str = "file_path") -> DataFrame:
    """rows with a flag for those whose file changed since it was indexed."""
    keys = stale_files.select("config_hash", F.col("path").alias(path)).distinct().withColumn("stale", F.lit(True))
    return rows.join(keys, ["config_hash", path], "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def align_is_project(files: DataFrame, project_prefixes: list[str]) -> DataFrame:
    """is_project raised to 1 for files below a project folder; never lowered."""
    inside = reduce(lambda a, b: a | b, [F.col("path").startswith(p) for p in project_prefixes], F.lit(False))
    return files.withColumn("is_project", F.when(inside, 1).otherwise(F.col("is_project")))


def unindexed_sources(disk: DataFrame, files: DataFrame) -> DataFrame:
    """Paths on disk that no build lists."""
    return disk.join(files.select("path").distinct(), "path", "left_anti")


def integrity(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """(check_name, bad): rows that break an invariant of the merged tables."""
    checks = [
        ("symbols without file", symbols.join(files.select("config_hash", F.col("id").alias("file_id")).distinct(), ["config_hash", "file_id"], "left_anti")),
        ("symbols repeated", symbols.groupBy("config_hash", "usr").count().where("count > 1")),
        ("references repeated", refs.groupBy(*SITE, "from_usr", "slot_index").count().where("count > 1")),
        ("references from unknown", refs.where("from_usr is not null").join(symbols.select("config_hash", F.col("usr").alias("from_usr")), ["config_hash", "from_usr"], "left_anti")),
        ("definitions without end", symbols.where("is_definition = 1 and end_line < line")),
    ]
    counted = [df.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(n).alias("check_name"), "bad") for n, df in checks]
    return reduce(DataFrame.unionByName, counted)
