"""Iterative operators over the call graph. Every loop joins a frontier with an edge table that was written once,
partitioned results of each round are written to the shared scratch folder, and the visited set is an anti-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import CALL_EDGES, CALLABLE, parameter_count
from quarrylens.runtime import materialize


#: Rounds after which an iteration writes anew what it has seen.
REWRITE = 8


def call_edges(refs: DataFrame, kinds: tuple[str, ...] = CALL_EDGES) -> DataFrame:
    """Distinct (config_hash, src, dst), src calling dst."""
    return refs.where(F.col("ref_kind").isin(*kinds) & (F.coalesce("from_usr", F.lit("")) != "")).select("config_hash", F.col("from_usr").alias("src"), F.col("to_usr").alias("dst")).distinct()


def alias_pairs(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(config_hash, decl_usr, def_usr): a referenced declaration without outgoing references and the definition
    __name, else _name, with as many parameters."""
    out = refs.where("from_usr is not null").select("config_hash", F.col("from_usr").alias("usr")).distinct()
    to = refs.select("config_hash", F.col("to_usr").alias("usr")).distinct()
    fn = symbols.where(F.col("kind").isin(*CALLABLE)).select("config_hash", "usr", "name", "is_definition", parameter_count(F.col("signature")).alias("n"))
    decl = fn.where("is_definition = 0").join(to, ["config_hash", "usr"], "left_semi").join(out, ["config_hash", "usr"], "left_anti")
    named = decl.select("config_hash", F.col("usr").alias("decl_usr"), "n", F.posexplode(F.array(F.concat(F.lit("__"), "name"), F.concat(F.lit("_"), "name"))).alias("pref", "name"))
    pairs = named.join(fn.where("is_definition = 1 and name like '\\\\_%'").select("config_hash", "name", "n", F.col("usr").alias("def_usr")), ["config_hash", "name", "n"])
    return pairs.groupBy("config_hash", "decl_usr").agg(F.min_by("def_usr", F.struct("pref", "def_usr")).alias("def_usr"))


def alias_edges(calls: DataFrame, pairs: DataFrame, forward: bool) -> DataFrame:
    """Call edges with those of the definitions behind declarations: forward a declaration calls what its definition
    calls, backward who calls the declaration calls the definition."""
    if forward:
        more = calls.join(pairs.select("config_hash", F.col("def_usr").alias("src"), "decl_usr"), ["config_hash", "src"]).select("config_hash", F.col("decl_usr").alias("src"), "dst")
    else:
        more = calls.join(pairs.select("config_hash", F.col("decl_usr").alias("dst"), "def_usr"), ["config_hash", "dst"]).select("config_hash", "src", F.col("def_usr").alias("dst"))
    return calls.unionByName(more).distinct()


def walk(edges: DataFrame, start: DataFrame, max_depth: int | None = 5, forward: bool = True) -> DataFrame:
    """(config_hash, target, usr, depth): all nodes within max_depth steps of each start, at their least depth; None: all.

    start has config_hash and usr. forward follows callees, else callers. The start itself appears only through a
    cycle. The frontier of each round is what is new, so cycles end. What was seen is written anew every REWRITE rounds,
    so that a deep walk doesn't read a table per round.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = materialize(edges.select("config_hash", F.col(a).alias("usr"), F.col(b).alias("next")), "walk-edges")
    front = start.select("config_hash", F.col("usr").alias("target"), "usr").distinct()
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(step, ["config_hash", "usr"]).select("config_hash", "target", F.col("next").alias("usr")).distinct()
        if seen is not None:
            new = new.join(seen, ["config_hash", "target", "usr"], "left_anti")
        front = materialize(new.withColumn("depth", F.lit(depth)), f"walk{depth}")
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
        if depth % REWRITE == 0:
            seen = materialize(seen, f"walked{depth}")
        front = front.select("config_hash", "target", "usr")
    return seen if seen is not None else start.select("config_hash", F.col("usr").alias("target"), "usr", F.lit(0).alias("depth")).limit(0)


def closure(edges: DataFrame) -> DataFrame:
    """(config_hash, src, dst): every pair with a path from src to dst, of any length.

    Pairs are joined with pairs, so that a round doubles the length of the paths it knows: a chain of n edges takes
    log n rounds. Only pairs that are new are joined, on either side.
    """
    new = materialize(edges.select("config_hash", "src", "dst").where("src is not null and dst is not null").distinct(), "closure")
    known = None
    while not new.isEmpty():
        known = new if known is None else materialize(known.unionByName(new), "closure")
        left = new.select("config_hash", "src", F.col("dst").alias("mid")).join(known.select("config_hash", F.col("src").alias("mid"), "dst"), ["config_hash", "mid"])
        right = known.select("config_hash", "src", F.col("dst").alias("mid")).join(new.select("config_hash", F.col("src").alias("mid"), "dst"), ["config_hash", "mid"])
        found = left.select("config_hash", "src", "dst").unionByName(right.select("config_hash", "src", "dst")).distinct()
        new = materialize(found.join(known, ["config_hash", "src", "dst"], "left_anti"), "closure-new")
    return new if known is None else known


def shortest_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, max_depth: int = 10) -> DataFrame:
    """(config_hash, src, dst, depth, path): one shortest path for each start and goal of a build.

    Level by level; of several parents at the same level the smallest usr is kept, so the answer is the same each time.
    """
    step = materialize(edges.select("config_hash", F.col("src").alias("usr"), F.col("dst").alias("next")), "path-edges")
    front = start.select("config_hash", F.col("usr").alias("origin"), "usr", F.array("usr").alias("path")).distinct()
    ends = goal.select("config_hash", F.col("usr")).distinct()
    seen, found = front.select("config_hash", "origin", "usr"), []
    for depth in range(1, max_depth + 1):
        new = front.join(step, ["config_hash", "usr"]).groupBy("config_hash", "origin", F.col("next").alias("usr")).agg(F.min(F.struct("usr", "path")).alias("p"))
        new = new.join(seen, ["config_hash", "origin", "usr"], "left_anti").select("config_hash", "origin", "usr", F.concat("p.path", F.array("usr")).alias("path"))
        front = materialize(new, f"path{depth}")
        if front.isEmpty():
            break
        found.append(front.join(ends, ["config_hash", "usr"], "left_semi").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front.select("config_hash", "origin", "usr"))
    shape = "config_hash string, src string, dst string, depth int, path array<string>"
    if not found:
        return edges.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, found).select("config_hash", F.col("origin").alias("src"), F.col("usr").alias("dst"), "depth", "path")


def call_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, max_depth: int = 10, limit: int = 5, max_nodes: int | None = 5_000) -> tuple[DataFrame, DataFrame]:
    """Paths (config_hash, src, dst, depth, path, rn) and outcomes (config_hash, src, dst, outcome).

    Of each start and goal the first limit shortest paths in the order of their nodes; a direct edge is one. A node keeps
    no more than limit paths a level, which is enough: the first paths to a node go through first paths. outcome is found,
    or not_found, or capped for starts that met more than max_nodes nodes before their goal.
    """
    step = materialize(edges.select("config_hash", F.col("src").alias("usr"), F.col("dst").alias("next")), "path-edges")
    front = start.select("config_hash", F.col("usr").alias("src"), "usr", F.array("usr").alias("path")).distinct()
    ends = materialize(goal.select("config_hash", F.col("usr").alias("dst")).distinct(), "path-goals")
    seen = front.select("config_hash", "src", "usr")
    pairs = front.select("config_hash", "src").distinct().join(ends, "config_hash")
    found, capped = [], []
    first = Window.partitionBy("config_hash", "src", "usr").orderBy("path")
    for depth in range(1, max_depth + 1):
        new = front.join(step, ["config_hash", "usr"]).select("config_hash", "src", F.col("next").alias("usr"), F.concat("path", F.array("next")).alias("path"))
        new = new.join(seen, ["config_hash", "src", "usr"], "left_anti").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= limit)
        front = materialize(new, f"paths{depth}")
        if front.isEmpty():
            break
        found.append(front.join(ends.withColumnRenamed("dst", "usr"), ["config_hash", "usr"], "left_semi").withColumn("depth", F.lit(depth)))
        seen = materialize(seen.unionByName(front.where("rn = 1").select("config_hash", "src", "usr")), f"paths-seen{depth}")
        # a start is done when all its goals are met, or when it has met too many nodes
        met = reduce(DataFrame.unionByName, found).select("config_hash", "src", F.col("usr").alias("dst")).distinct()
        left = pairs.join(met, ["config_hash", "src", "dst"], "left_anti")
        if max_nodes is not None:
            many = materialize(seen.groupBy("config_hash", "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_nodes).select("config_hash", "src"), f"paths-many{depth}")
            capped.append(many)
            left = left.join(many, ["config_hash", "src"], "left_anti")
        front = front.drop("rn").join(left.select("config_hash", "src").distinct(), ["config_hash", "src"], "left_semi")
    spark = edges.sparkSession
    paths = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "config_hash string, src string, usr string, path array<string>, rn int, depth int")
    paths = paths.select("config_hash", "src", F.col("usr").alias("dst"), "depth", "path", "rn")
    hit = paths.select("config_hash", "src", "dst").distinct().withColumn("hit", F.lit(True))
    over = reduce(DataFrame.unionByName, capped).distinct().withColumn("over", F.lit(True)) if capped else spark.createDataFrame([], "config_hash string, src string, over boolean")
    outcomes = pairs.join(hit, ["config_hash", "src", "dst"], "left").join(over, ["config_hash", "src"], "left")
    outcome = F.when(F.col("hit"), "found").when(F.col("over"), "capped").otherwise("not_found")
    return paths, outcomes.select("config_hash", "src", "dst", outcome.alias("outcome"))


def dead_code(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(config_hash, usr, category, sites): callable definitions never referred to (dead), or only indirectly
    (possibly_dead) with up to three sites in order."""
    fn = symbols.where((F.col("is_definition") == 1) & F.col("kind").isin(*CALLABLE)).select("config_hash", "usr", "name", "kind", "file_path", "is_project")
    kinds = refs.groupBy("config_hash", F.col("to_usr").alias("usr")).agg(
        F.bool_or(F.col("ref_kind") == "call").alias("called"), F.bool_or(F.col("ref_kind") == "indirect").alias("indirect")
    )
    joined = fn.join(kinds, ["config_hash", "usr"], "left")
    dead = joined.where("called is null").withColumn("category", F.lit("dead")).withColumn("sites", F.lit(None).cast("string"))
    maybe = joined.where("indirect and not called")
    place = F.concat_ws(":", "from_file", F.col("from_line").cast("string"))
    first = refs.where("ref_kind = 'indirect'").select("config_hash", F.col("to_usr").alias("usr"), place.alias("site")).distinct()
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("config_hash", "usr").orderBy("site"))).where("r <= 3")
    sites = first.groupBy("config_hash", "usr").agg(F.array_join(F.array_sort(F.collect_list("site")), ", ").alias("sites"))
    possibly = maybe.join(sites, ["config_hash", "usr"], "left").withColumn("category", F.lit("possibly_dead"))
    cols = ["config_hash", "usr", "name", "kind", "file_path", "is_project", "category", "sites"]
    return dead.select(*cols).unionByName(possibly.select(*cols))


def hotspots(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(config_hash, usr, name, kind, caller_count): call sites of each callable definition; combined before the join."""
    counts = refs.where(F.col("ref_kind").isin(*CALL_EDGES)).groupBy("config_hash", F.col("to_usr").alias("usr")).agg(F.count(F.lit(1)).alias("caller_count"))
    return symbols.where("is_definition = 1").select("config_hash", "usr", "name", "kind", "file_path", "is_project").join(counts, ["config_hash", "usr"])


def pagerank(symbols: DataFrame, refs: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, normalise: bool = True, stride: int = 5) -> DataFrame:
    """(config_hash, usr, pagerank) of the callables that take part in distinct call edges; the largest of a build is 1.

    Dangling weight isn't handed out again. Rounds are planned stride at a time and then written; the loop ends when the
    summed change of the last round of every build is below tolerance. Edges carry their source's out-degree and are written once; each round is one join and one aggregate with map-side
    combining, so a function with a third of all callers is no hot task.
    """
    fn = symbols.where(F.col("kind").isin(*CALLABLE, "lambda") & (F.col("usr") != "")).select("config_hash", "usr")
    edges = call_edges(refs, ("call",)).join(fn.withColumnRenamed("usr", "src"), ["config_hash", "src"], "left_semi").join(fn.withColumnRenamed("usr", "dst"), ["config_hash", "dst"], "left_semi")
    degree = edges.groupBy("config_hash", "src").agg(F.count(F.lit(1)).alias("deg"))
    edges = materialize(edges.join(degree, ["config_hash", "src"]), "rank-edges")
    nodes = edges.select("config_hash", F.col("src").alias("usr")).union(edges.select("config_hash", F.col("dst").alias("usr"))).distinct()
    size = nodes.groupBy("config_hash").agg(F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.join(size, "config_hash"), "rank-nodes")
    score = nodes.select("config_hash", "usr", (1.0 / F.col("n")).alias("score"))
    def step(score: DataFrame) -> DataFrame:
        given = edges.join(score.withColumnRenamed("usr", "src"), ["config_hash", "src"]).groupBy("config_hash", F.col("dst").alias("usr")).agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
        return nodes.join(given, ["config_hash", "usr"], "left").select("config_hash", "usr", ((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("score"))

    done = 0
    while done < rounds:
        ahead = min(stride, rounds - done)
        for _ in range(ahead - 1):
            score = step(score)
        was = materialize(score, f"rank{done}") if tolerance > 0 else score
        score, done = materialize(step(was), f"rank{done + ahead}"), done + ahead
        if tolerance > 0:
            moved = score.join(was.withColumnRenamed("score", "was"), ["config_hash", "usr"]).groupBy("config_hash").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("d"))
            if (moved.agg(F.max("d")).first()[0] or 0.0) < tolerance:
                break
    if normalise:
        top = score.groupBy("config_hash").agg(F.max("score").alias("top"))
        return score.join(top, "config_hash").select("config_hash", "usr", (F.col("score") / F.col("top")).alias("pagerank"))
    return score.withColumnRenamed("score", "pagerank")


def inheritance_closure(inheritance: DataFrame, up: bool = True, max_depth: int = 10) -> DataFrame:
    """(config_hash, start_usr, usr, depth, access, is_virtual): all bases (or derived types) of every type at their least
    depth, with the access of the first edge in usr order that found them."""
    a, b = ("derived_usr", "base_usr") if up else ("base_usr", "derived_usr")
    step = materialize(inheritance.select("config_hash", F.col(a).alias("usr"), F.col(b).alias("next"), "access", "is_virtual").distinct(), "bases")
    front = step.select("config_hash", F.col("usr").alias("start_usr"), "usr").distinct()
    seen, out = front, []
    for depth in range(1, max_depth + 1):
        new = front.join(step, ["config_hash", "usr"]).groupBy("config_hash", "start_usr", F.col("next").alias("usr")).agg(F.min(F.struct("usr", "access", "is_virtual")).alias("e"))
        new = new.join(seen, ["config_hash", "start_usr", "usr"], "left_anti").select("config_hash", "start_usr", "usr", F.lit(depth).alias("depth"), "e.access", "e.is_virtual")
        level = materialize(new, f"bases{depth}")
        if level.isEmpty():
            break
        out.append(level)
        front = level.select("config_hash", "start_usr", "usr")
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, out) if out else step.select("config_hash", F.col("usr").alias("start_usr"), "usr", F.lit(0).alias("depth"), "access", "is_virtual").limit(0)


def close_overrides(overrides: DataFrame) -> DataFrame:
    """Override pairs with all pairs that follow from them, however many levels apart."""
    pairs = closure(overrides.select("config_hash", F.col("derived_usr").alias("src"), F.col("base_usr").alias("dst")))
    return pairs.select("config_hash", F.col("src").alias("derived_usr"), F.col("dst").alias("base_usr"))


def data_flow(symbols: DataFrame, refs: DataFrame, type_name: str, to: str, max_depth: int = 8, limit: int = 15) -> DataFrame:
    """Functions whose signature names a type, most-called first, each with a shortest path to the target."""
    users = hotspots(symbols, refs).join(symbols.where(F.lower("signature").contains(type_name.lower())).select("config_hash", "usr"), ["config_hash", "usr"], "left_semi")
    first = users.withColumn("r", F.row_number().over(Window.partitionBy("config_hash").orderBy(F.desc("caller_count"), "usr"))).where(F.col("r") <= limit)
    goal = symbols.where(F.col("name") == to)
    return shortest_paths(call_edges(refs), first, goal, max_depth)


def expand_context(found: DataFrame, symbols: DataFrame, refs: DataFrame, more: int = 5) -> DataFrame:
    """Callers and callees (call edges only, project definitions) of found symbols that aren't among them, first ones per build."""
    edges = call_edges(refs, ("call",))
    own = found.select("config_hash", "usr").distinct()
    near = edges.join(own.withColumnRenamed("usr", "dst"), ["config_hash", "dst"], "left_semi").select("config_hash", F.col("src").alias("usr")).union(
        edges.join(own.withColumnRenamed("usr", "src"), ["config_hash", "src"], "left_semi").select("config_hash", F.col("dst").alias("usr"))).distinct()
    new = near.join(own, ["config_hash", "usr"], "left_anti").join(symbols.where("is_project = 1 and is_definition = 1"), ["config_hash", "usr"])
    turn = F.row_number().over(Window.partitionBy("config_hash", "kind").orderBy("usr"))
    return new.withColumn("turn", turn).withColumn("r", F.row_number().over(Window.partitionBy("config_hash").orderBy("turn", "kind", "usr"))).where(F.col("r") <= more)
