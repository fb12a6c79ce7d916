"""Aggregates of builds, coverage, consensus and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_stats(symbols: DataFrame) -> DataFrame:
    """Symbols, definitions and documented symbols per build and kind."""
    return symbols.groupBy("config_hash", "kind").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("is_definition").alias("definitions"), F.sum(F.when(F.col("docstring") != "", 1).otherwise(0)).alias("documented")
    )


def build_totals(builds: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame, macros: DataFrame) -> DataFrame:
    """(config_hash, symbols, definitions, files, refs, macros) of every build; each table is counted before it is joined."""
    counted = [
        symbols.groupBy("config_hash").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("is_definition") == 1).alias("definitions")),
        files.groupBy("config_hash").agg(F.countDistinct("id").alias("files")), refs.groupBy("config_hash").agg(F.count(F.lit(1)).alias("refs")),
        macros.groupBy("config_hash").agg(F.count(F.lit(1)).alias("macros")),
    ]
    out = builds.select("config_hash")
    for df in counted:
        out = out.join(df, "config_hash", "left")
    return out.fillna(0)


def coverage(symbols: DataFrame, analysed: DataFrame) -> DataFrame:
    """Definitions per build and is_project, and those with an analysis; unnamed symbols don't count."""
    own = symbols.where((F.col("is_definition") == 1) & ~F.col("name").contains("(unnamed"))
    return own.join(analysed.withColumn("__a", F.lit(1)), "id", "left").groupBy("config_hash", "is_project").agg(F.count(F.lit(1)).alias("total"), F.count("__a").alias("analysed"))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def missing(rows: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return rows.join(have, key, "left_anti")


def project_counts(projects: DataFrame, builds: DataFrame, symbols: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """Builds of each project with counts; each table is counted before it is joined."""
    out = projects.select("project_id").join(builds.select("project_id", "config_hash"), "project_id", "left")
    for name, df, key in (("symbols", symbols, "usr"), ("files", files, "id"), ("refs", refs, "id")):
        out = out.join(df.groupBy("config_hash").agg(F.countDistinct(key).alias(name)), "config_hash", "left")
    return out.fillna(0, ["symbols", "files", "refs"])


def consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, states, agreed, most): the values of each key; agreed only if there is one; most is the largest count."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("units"))
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("states"), F.when(F.count(F.lit(1)) == 1, F.min(value)).alias("agreed"), F.max("units").alias("most"))


def ordered_states(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, states): values with their counts, most frequent first, then by value."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("units"))
    return counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("units")).alias("m"), F.col(value).alias("value")))).alias("s")).select(
        *keys, F.transform("s", lambda r: F.struct(r["value"].alias("value"), (-r["m"]).alias("units"))).alias("states"))


def odr_groups(types: DataFrame, keys: list[str], mains: DataFrame) -> DataFrame:
    """Types that stand in several files, none of them a main file (path), with the place that represents them."""
    marked = types.select(*keys, "file_path").distinct().join(mains.select(F.col("path").alias("file_path")).distinct().withColumn("m", F.lit(True)), "file_path", "left")
    found = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.min("file_path").alias("place"), F.coalesce(F.bool_or("m"), F.lit(False)).alias("m"))
    return found.where("files > 1 and not m").drop("m")


def retrieval_metrics(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """MRR, recall and precision at each k and NDCG at the last k per query.

    results: query, rank (from 1), name; gold: query, name. Without gold recall is 1; precision divides by the smaller
    of k and the results; a query without results has 0 everywhere.
    """
    n_gold = gold.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("gold"))
    n_res = results.groupBy("query").agg(F.count(F.lit(1)).alias("shown"))
    hits = results.join(gold.distinct().withColumn("hit", F.lit(1)), ["query", "name"], "left").fillna(0, ["hit"])
    first = hits.withColumn("fresh", F.when((F.col("hit") == 1) & (F.row_number().over(Window.partitionBy("query", "name").orderBy("rank")) == 1), 1).otherwise(0))
    top = ks[-1]
    aggs = [F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")]
    for k in ks:
        aggs += [F.sum(F.when(F.col("rank") <= k, F.col("fresh"))).alias(f"found{k}"), F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"hits{k}")]
    aggs.append(F.sum(F.when(F.col("rank") <= top, F.col("fresh") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    queries = results.select("query").union(gold.select("query")).distinct()
    full = queries.join(first.groupBy("query").agg(*aggs), "query", "left").join(n_gold, "query", "left").join(n_res, "query", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("gold"), F.lit(top)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    none = F.col("shown") == 0
    cols = [F.col("query"), F.col("mrr")]
    for k in ks:
        cols.append(F.when(none, 0.0).when(F.col("gold") == 0, 1.0).otherwise(F.col(f"found{k}") / F.col("gold")).alias(f"recall{k}"))
        cols.append(F.when(none, 0.0).otherwise(F.col(f"hits{k}") / F.least(F.lit(k), F.greatest("shown", F.lit(1)))).alias(f"precision{k}"))
    cols.append(F.when(none | (F.col("gold") == 0), 0.0).otherwise(F.col("dcg") / ideal).alias(f"ndcg{top}"))
    return full.select(*cols)


def average_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every metric, per variant if by names its column; the same order of columns for an A/B join."""
    names = [c for c in metrics.columns if c not in ("query", *(by or []))]
    return metrics.groupBy(*(by or [])).agg(*[F.avg(c).alias(c) for c in names])


def compare_metrics(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(metric, a, b, gain): the means of two variants side by side."""
    long = lambda df, side: df.agg(*[F.avg(n).alias(n) for n in names]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(side)) for n in names])).alias("x")).select("x.*")
    return long(a, "a").join(long(b, "b"), "metric").withColumn("gain", F.col("b") - F.col("a"))


def metric_grid(metrics: DataFrame, by: list[str], best: str) -> DataFrame:
    """The means of every variant (by), ranked by one of them."""
    means = average_metrics(metrics, by)
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(best), *by)))  # one row a variant
