"""Name resolution and lookups over merged symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import CALLABLE, CALL_EDGES, suggestion_tokens


def match_rank(name: str) -> Column:
    """0 exact qualified name (only if name holds ::), 1 exact name, 2 suffix ::name, 3 the tail of name; null: no match."""
    tail = name.rsplit("::", 1)[-1]
    exact = F.when(F.col("qualified_name") == name, 0) if "::" in name else None
    rank = exact.when(F.col("name") == name, 1) if exact is not None else F.when(F.col("name") == name, 1)
    return rank.when(F.col("qualified_name").endswith("::" + name), 2).when(F.col("qualified_name") == name, 2).when(F.col("name") == tail, 3)


def resolve(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """Candidates of the best rank per build, with reference counts, in order of preference (rn)."""
    matched = symbols.withColumn("match_rank", match_rank(name)).where("match_rank is not null")
    least = matched.groupBy("config_hash").agg(F.min("match_rank").alias("match_rank"))
    best = matched.join(least, ["config_hash", "match_rank"])
    keys = best.select("config_hash", "usr")
    inward = refs.join(keys.withColumnRenamed("usr", "to_usr"), ["config_hash", "to_usr"], "left_semi").groupBy("config_hash", F.col("to_usr").alias("usr")).agg(F.count(F.lit(1)).alias("ref_count"))
    outward = refs.join(keys.withColumnRenamed("usr", "from_usr"), ["config_hash", "from_usr"], "left_semi").groupBy("config_hash", F.col("from_usr").alias("usr")).agg(F.count(F.lit(1)).alias("out_count"))
    full = best.join(inward, ["config_hash", "usr"], "left").join(outward, ["config_hash", "usr"], "left").fillna(0, ["ref_count", "out_count"])
    order = Window.partitionBy("config_hash").orderBy("match_rank", F.desc("is_definition"), F.desc("is_project"), F.desc("ref_count"), F.desc("out_count"), "usr")
    return full.withColumn("rn", F.row_number().over(order))


#: The order of a lookup; it ends in what is unique.
LOOKUP_ORDER = ("is_definition desc", "line", "file_path", "usr")
#: Fixed value: the longest page of a lookup.
LOOKUP_PAGE = 100


def lookup_hits(symbols: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Symbols by exact name or by prefix without regard to ASCII case."""
    if exact:
        return symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    return symbols.where(F.lower("name").startswith(name.lower()) | F.lower("qualified_name").startswith(name.lower()))


def with_owner(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows with owner: the name of the class, struct or union around a symbol, else empty."""
    around = symbols.where("kind in ('class', 'struct', 'union')").select("config_hash", F.col("usr").alias("parent_usr"), F.col("name").alias("owner"))
    return rows.join(around, ["config_hash", "parent_usr"], "left").withColumn("owner", F.coalesce("owner", F.lit("")))


def lookup(symbols: DataFrame, name: str, exact: bool = True, limit: int = LOOKUP_PAGE, offset: int = 0) -> DataFrame:
    """One page per build of the symbols of a name or prefix in lookup order (rn); every task keeps its first ones only."""
    order = Window.partitionBy("config_hash").orderBy(*[F.expr(c) if " " not in c else F.desc(c.split()[0]) for c in LOOKUP_ORDER])
    numbered = lookup_hits(symbols, name, exact).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= offset + min(limit, LOOKUP_PAGE))
    return numbered.where(F.col("rn") > offset)


def lookup_definition(symbols: DataFrame, name: str, kinds: tuple[str, ...] = CALLABLE) -> DataFrame:
    """One row per build: name before qualified name before tail, definitions first, assembler symbols last."""
    tier = F.when(F.col("name") == name, 0).when(F.col("qualified_name") == name, 1).when(F.col("qualified_name").endswith("::" + name.rsplit("::", 1)[-1]), 2)
    order = Window.partitionBy("config_hash").orderBy(
        F.desc("is_definition"), "tier", F.col("usr").startswith("asm:"), ~F.col("kind").isin(*kinds), F.desc("is_project"), "line", "usr"
    )
    hits = symbols.withColumn("tier", tier).where("tier is not null")
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def link_definition(symbols: DataFrame) -> DataFrame:
    """(config_hash, link_name, usr): the definition a link name stands for; none where the best rank is tied.

    Strong definitions come before weak objects, those before weak linker-script names, those before declarations.
    """
    rank = F.when((F.col("is_definition") == 1) & (F.col("is_weak") == 0), 0).when((F.col("is_weak") == 1) & ~F.col("usr").startswith("ld:"), 1).when(F.col("is_weak") == 1, 2).otherwise(3)
    named = symbols.where("link_name <> ''").select("config_hash", "link_name", "usr", rank.alias("r"))
    best = named.groupBy("config_hash", "link_name").agg(F.min("r").alias("r"))
    tied = named.join(best, ["config_hash", "link_name", "r"]).groupBy("config_hash", "link_name", "r").agg(F.min("usr").alias("usr"), F.max("usr").alias("other"))
    return tied.where("usr = other").select("config_hash", "link_name", "usr", F.col("r").alias("link_rank"))


def candidate_labels(candidates: DataFrame) -> DataFrame:
    """A label for each candidate: its name, with its file where the name comes twice, with its parameters where name and
    file do; adds ambiguous, the number of candidates that share the name."""
    n = F.count(F.lit(1)).over(Window.partitionBy("config_hash", "qualified_name"))
    same = F.count(F.lit(1)).over(Window.partitionBy("config_hash", "qualified_name", "file_path"))
    file = F.concat(F.lit(" ("), "file_path", F.lit(")"))
    params = F.regexp_extract(F.coalesce("signature", F.lit("")), r"(\(.*\))", 1)
    label = F.when(n == 1, F.col("qualified_name")).when(same == 1, F.concat("qualified_name", file)).otherwise(F.concat("qualified_name", params, file))
    return candidates.withColumn("label", label).withColumn("ambiguous", n)


def ambiguity_notice(candidates: DataFrame, shown: int = 5) -> DataFrame:
    """(config_hash, candidates, notice): for builds where a name has several candidates, how many, and the first labels."""
    order = Window.partitionBy("config_hash").orderBy("rn", "usr")
    first = candidate_labels(candidates).withColumn("place", F.row_number().over(order))
    told = first.groupBy("config_hash").agg(F.count(F.lit(1)).alias("candidates"), F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "label")))).alias("l"))
    return told.where("candidates > 1").select("config_hash", "candidates", F.array_join(F.transform("l", lambda x: x["label"]), "; ").alias("notice"))


def find_variables(symbols: DataFrame, part: str, kinds: tuple[str, ...] = ("varglobal", "varlocal", "variable")) -> DataFrame:
    """Variables whose name holds a text, with their parent's name and kind."""
    own = symbols.where((F.col("is_definition") == 1) & F.col("kind").isin(*kinds) & F.lower("name").contains(part.lower()))
    parent = symbols.select("config_hash", F.col("usr").alias("parent_usr"), F.col("qualified_name").alias("parent_name"), F.col("kind").alias("parent_kind"))
    return own.join(parent, ["config_hash", "parent_usr"], "left")


def file_map(symbols: DataFrame, per_kind: int = 30) -> DataFrame:
    """The first symbols of each kind of each file beside the kind's true count."""
    w = Window.partitionBy("config_hash", "file_path", "kind")
    return symbols.withColumn("kind_total", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("line", "col", "usr"))).where(F.col("rn") <= per_kind)


def file_map_kind(symbols: DataFrame, path: str, kind: str, limit: int = 30, offset: int = 0) -> DataFrame:
    """One page of the symbols of one kind in the files of a path, in the order of the file map; enum constants with their enum."""
    own = symbols.where((F.col("file_path") == path) & (F.col("kind") == kind))
    parent = symbols.where("kind = 'enum'").select("config_hash", F.col("usr").alias("parent_usr"), F.col("name").alias("enum_name"))
    return own.join(parent, ["config_hash", "parent_usr"], "left").orderBy("config_hash", "line", "col", "usr").offset(offset).limit(limit)


def file_map_enums(symbols: DataFrame) -> DataFrame:
    """(config_hash, file_path, usr, constants): the enums of each file with the names of their constants in order."""
    constant = symbols.where("kind = 'enum_constant'").select("config_hash", F.col("parent_usr").alias("usr"), F.struct("line", "col", "name").alias("c"))
    held = constant.groupBy("config_hash", "usr").agg(F.sort_array(F.collect_list("c")).alias("c"))  # as long as the enum's text is
    enums = symbols.where("kind = 'enum'").select("config_hash", "file_path", "usr")
    return enums.join(held, ["config_hash", "usr"], "left").select("config_hash", "file_path", "usr", F.coalesce(F.transform("c", lambda x: x["name"]), F.array().cast("array<string>")).alias("constants"))


def match_path(files: DataFrame, path: str) -> DataFrame:
    """Files of that path, or if none has it those that end in it, per build."""
    low = path.lower()
    hits = files.withColumn("path_rank", F.when(F.col("path") == path, 0).when(F.lower("path").endswith(low), 1)).where("path_rank is not null")
    best = hits.groupBy("config_hash").agg(F.min("path_rank").alias("path_rank"))
    return hits.join(best, ["config_hash", "path_rank"])


def project_filter(df: DataFrame, project_only: bool = True, excluded: tuple[str, ...] = (), path: str = "file_path") -> DataFrame:
    """Project rows without those whose path ends in an excluded pattern's text."""
    keep = (F.col("is_project") == 1) if project_only else F.lit(True)
    return df.where(reduce(lambda a, p: a & ~F.lower(path).contains(p.lower()), excluded, keep))


def kind_filter(kinds: list[str] | None) -> Column:
    """No list: everything; an empty list: nothing."""
    return F.lit(True) if kinds is None else F.col("ref_kind").isin(*kinds) if kinds else F.lit(False)


def class_members(symbols: DataFrame, parent_usr: str) -> DataFrame:
    return symbols.where(F.col("parent_usr") == parent_usr)


def template_instances(symbols: DataFrame, template_usr: str | None = None) -> DataFrame:
    """The instances of a template, or of all templates."""
    return symbols.where(F.col("template_usr") != "" if template_usr is None else F.col("template_usr") == template_usr)


def enum_constants(symbols: DataFrame, enum_name: str, cap: int = 200) -> DataFrame:
    return symbols.where((F.col("kind") == "enum_constant") & F.col("qualified_name").startswith(enum_name + "::")).orderBy("line", "usr").limit(cap)


def suggest(symbols: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Did you mean: (name, score). Each word of the query scores at the first word of a candidate that equals it (2) or,
    from three letters on, begins with it (1), and half a point more at the same place."""
    spark = symbols.sparkSession
    asked = spark.range(1).select(suggestion_tokens(F.lit(name)).alias("t")).first()["t"]
    names = symbols.where((F.col("is_definition") == 1) & F.col("kind").isin(*CALLABLE)).select("name").distinct()
    scored = names.withColumn("t", suggestion_tokens(F.col("name")))
    points = []
    for i, word in enumerate(asked):
        hit = lambda x, w=word: (x == w) | ((F.length(F.lit(w)) >= 3) & x.startswith(w))
        places = F.filter(F.transform("t", lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda r: hit(r["x"]))
        first = F.try_element_at(places, F.lit(1))
        points.append(F.when(first.isNull(), 0.0).otherwise(F.when(first["x"] == word, 2.0).otherwise(1.0) + F.when(first["j"] == i, 0.5).otherwise(0.0)))
    score = reduce(lambda a, b: a + b, points, F.lit(0.0))
    return scored.select("name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.length("name"), "name").limit(limit)


def source_lines(symbols: DataFrame, cap: int | None = None) -> DataFrame:
    """(config_hash, usr, line_no, text): bodies by absolute line."""
    body = F.col("source") if cap is None else F.substring("source", 1, cap)
    return symbols.where("source is not null").select("config_hash", "usr", "line", F.posexplode(F.split(body, "\n")).alias("pos", "text")).select(
        "config_hash", "usr", (F.col("line") + F.col("pos")).alias("line_no"), "text"
    )


def file_page(files: DataFrame, start: int, count: int, content: str = "content") -> DataFrame:
    """Lines start .. start + count - 1 (from 1) of each file's text."""
    return files.withColumn("lines", F.slice(F.split(content, "\n"), start, count))


def context_sections(symbols: DataFrame, refs: DataFrame, overrides: DataFrame, name: str, shown: int = 5) -> DataFrame:
    """(section, config_hash, usr, other_usr, other_name, total, rn): what surrounds each symbol of a name: body, callers, callees,
    indirect callers, overrides, what overrides it, members and constants; the first ones by name and usr with the section's total."""
    own = symbols.where(F.col("name") == name).select("config_hash", "usr")
    edges = refs.where(F.col("ref_kind").isin(*CALL_EDGES) & F.col("from_usr").isNotNull())
    side = lambda df, key, other: df.join(own.withColumnRenamed("usr", key), ["config_hash", key], "left_semi").select("config_hash", F.col(key).alias("usr"), F.col(other).alias("other_usr")).distinct()
    parts = [
        ("body", symbols.where("source is not null").join(own, ["config_hash", "usr"], "left_semi").select("config_hash", "usr", F.col("usr").alias("other_usr"))),
        ("callers", side(edges, "to_usr", "from_usr")), ("callees", side(edges, "from_usr", "to_usr")), ("indirect", side(edges.where("ref_kind = 'indirect'"), "to_usr", "from_usr")),
        ("overrides", side(overrides, "derived_usr", "base_usr")), ("overridden_by", side(overrides, "base_usr", "derived_usr")),
        ("members", side(symbols.where("kind <> 'enum_constant'"), "parent_usr", "usr")), ("constants", side(symbols.where("kind = 'enum_constant'"), "parent_usr", "usr")),
    ]
    rows = reduce(DataFrame.unionByName, [df.withColumn("section", F.lit(s)) for s, df in parts])
    named = rows.join(symbols.select("config_hash", F.col("usr").alias("other_usr"), F.col("qualified_name").alias("other_name")), ["config_hash", "other_usr"], "left")
    totals = rows.groupBy("section", "config_hash", "usr").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("section", "config_hash", "usr").orderBy("other_name", "other_usr")
    first = named.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= shown)
    return first.join(totals, ["section", "config_hash", "usr"]).select("section", "config_hash", "usr", "other_usr", "other_name", "total", "rn")


def context_counts(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """Sections of a symbol's context with their totals: callers, callees, indirect, members, template instances."""
    own = symbols.where(F.col("name") == name).select("config_hash", "usr")
    to = refs.join(own.withColumnRenamed("usr", "to_usr"), ["config_hash", "to_usr"], "left_semi")
    out = refs.join(own.withColumnRenamed("usr", "from_usr"), ["config_hash", "from_usr"], "left_semi")
    parts = [
        ("callers", to.where(F.col("ref_kind").isin(*CALL_EDGES))), ("callees", out.where(F.col("ref_kind").isin(*CALL_EDGES))),
        ("indirect", to.where("ref_kind = 'indirect'")),
        ("members", symbols.join(own.withColumnRenamed("usr", "parent_usr"), ["config_hash", "parent_usr"], "left_semi")),
    ]
    return reduce(DataFrame.unionByName, [df.groupBy("config_hash").agg(F.count(F.lit(1)).alias("total")).select(F.lit(n).alias("section"), "config_hash", "total") for n, df in parts])


