"""Queries of the problems 4, 5, 6, 8, 9 and 10, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bpe, docpairs, mixing, neighbours, residue, survivors
from quarrylens.runtime import load, materialize


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docpairs.documented_functions(load(spark, sf_dir, "symbols_fts"), load(spark, sf_dir, "symbols"))
    return pairs.select("symbol_id").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docpairs.documented_functions(load(spark, sf_dir, "symbols_fts"), load(spark, sf_dir, "symbols"))
    return pairs.groupBy("symbol_id").agg(*[F.min(c).alias(c) for c in ("name", "declaration", "description", "code")])


def p4_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source read as a file of its own: its functions with the comments that touch them."""
    return docpairs.file_pairs(load(spark, sf_dir, "symbols_fts"), "symbol_id", "source").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.similar_pairs(load(spark, sf_dir, "embedding_stash"))
    return pairs.select(F.col("id_a").alias("stash_id_a"), F.col("id_b").alias("stash_id_b"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.neighbour_graph(load(spark, sf_dir, "embedding_stash")).neighbours()
    return near.select(F.col("id").alias("stash_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("similarity", 3).alias("similarity"))


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = neighbours.neighbour_graph(load(spark, sf_dir, "embedding_stash"))
    asked = graph.members().where("id % 50 = 0").select(F.col("id").alias("query"), "model", "h", "q")
    return neighbours.greedy_search(graph, asked).select("query", F.col("id").alias("stash_id"), "rank")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the survivors of several ids. The surviving rows are built whole, their fields by truth discovery, and written first."""
    whole = materialize(survivors.survivors(load(spark, sf_dir, "symbols")), "survivors")
    return whole.where("several").select("config_hash", "usr", "best_id")


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(load(spark, sf_dir, "symbols"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))
    return plan.where("not reachable").select("mix_id", "source").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(load(spark, sf_dir, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(load(spark, sf_dir, "documents")).select("doc_id", "source", "doc_kind", "n_chars")


QUERIES = {
    "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_file_pairs": p4_file_pairs, "p5_found": p5_found, "p5_neighbours": p5_neighbours,
    "p5_search": p5_search, "p6_found": p6_found, "p6_survivors": p6_survivors, "p8_ids": p8_ids,
    "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found, "p10_clean": p10_clean,
}

SQL = {
    "p5_found": """WITH v AS (SELECT stash_id, model, content_hash, list_transform(embedding, lambda x: x::DOUBLE) AS e
FROM embedding_stash WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)
SELECT a.stash_id AS stash_id_a, b.stash_id AS stash_id_b FROM v a JOIN v b ON a.model = b.model AND a.stash_id < b.stash_id
WHERE a.content_hash <> b.content_hash AND list_cosine_similarity(a.e, b.e) >= 0.9""",
    # any usual tokenizer gives the same rows; here words and marks are counted
    "p9_found": """WITH d AS (SELECT trim(lower(source)) AS name, len(regexp_extract_all(coalesce(text, ''), '\\w+|[^\\w\\s]'))::BIGINT AS n FROM documents),
s AS (SELECT name, sum(n) AS n FROM d GROUP BY 1), t AS (SELECT sum(n) AS total FROM d)
SELECT DISTINCT m.mix_id, m.source FROM mix_targets m LEFT JOIN s ON s.name = trim(lower(m.source)), t WHERE m.max_repeats * coalesce(s.n, 0) < m.target_share * t.total""",
    "p6_found": """WITH r AS (SELECT config_hash, usr, id, row_number() OVER (PARTITION BY config_hash, usr ORDER BY
removed_at IS NOT NULL, is_definition = 1 DESC, is_weak = 0 DESC, is_tentative = 0 DESC,
regexp_matches(lower(file_path), '\\.(h|hh|hpp|inc)$'),
(CASE WHEN regexp_matches(signature, '\\S') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(docstring, '\\S') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(source, '\\S') THEN 1 ELSE 0 END) DESC, seen_at DESC, id) AS k,
min(id) OVER (PARTITION BY config_hash, usr) <> max(id) OVER (PARTITION BY config_hash, usr) AS several FROM symbols)
SELECT config_hash, usr, id AS best_id FROM r WHERE k = 1 AND several""",
}


def _survivor_sql(rounds: int = 24) -> str:
    """p6_survivors with the rounds of truth discovery written out; once no weight moves by more than the tolerance they stand still."""
    path = "regexp_replace(regexp_replace(regexp_replace(coalesce(file_path, ''), '\\\\', '/', 'g'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
    claims = " UNION ALL ".join(
        f"SELECT config_hash, usr, k, src, '{f}' AS f, {path if f == 'file_path' else f} AS v FROM r WHERE regexp_matches({f}, '\\S')" for f in survivors.FIELDS)
    out = f"""WITH r AS (SELECT *, concat_ws('|', lower(regexp_extract({path}, '^/?([^/]*)/', 1)), lower(regexp_extract({path}, '\\.(\\w+)$', 1)), coalesce(is_definition, 0)) AS src,
row_number() OVER (PARTITION BY config_hash, usr ORDER BY
removed_at IS NOT NULL, is_definition = 1 DESC, is_weak = 0 DESC, is_tentative = 0 DESC,
regexp_matches(lower(file_path), '\\.(h|hh|hpp|inc)$'),
(CASE WHEN regexp_matches(signature, '\\S') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(docstring, '\\S') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(source, '\\S') THEN 1 ELSE 0 END) DESC, seen_at DESC, id) AS k,
min(id) OVER (PARTITION BY config_hash, usr) <> max(id) OVER (PARTITION BY config_hash, usr) AS several FROM symbols),
c AS ({claims}),
s AS (SELECT config_hash, usr, f, v, src, min(k) AS k FROM c GROUP BY ALL),
rival AS (SELECT * FROM s QUALIFY min(v) OVER (PARTITION BY config_hash, usr, f) <> max(v) OVER (PARTITION BY config_hash, usr, f)),
w0 AS MATERIALIZED (SELECT DISTINCT src, 1.0::DOUBLE AS weight, false AS still FROM rival)"""
    for i in range(1, rounds + 1):
        out += f""",
v{i} AS (SELECT config_hash, usr, f, v, sum(weight) AS support FROM rival JOIN w{i - 1} USING (src) GROUP BY ALL),
h{i} AS (SELECT *, support / sum(support) OVER (PARTITION BY config_hash, usr, f) AS share FROM v{i}),
p{i} AS (SELECT src, -ln(1 - least(greatest((sum(share) + 1) / (count(*) + 2), 0.05), 0.95)) AS weight FROM rival JOIN h{i} USING (config_hash, usr, f, v) GROUP BY src),
n{i} AS (SELECT p.src, p.weight / (SELECT avg(weight) FROM p{i}) AS weight, o.weight AS was, o.still FROM p{i} p JOIN w{i - 1} o USING (src)),
w{i} AS MATERIALIZED (SELECT src, CASE WHEN still THEN was ELSE weight END AS weight, still OR max(abs(weight - was)) OVER () <= {survivors.TOLERANCE} AS still FROM n{i})"""
    columns = ", ".join(f"max(CASE WHEN f = '{f}' THEN v END) AS {f}" for f in survivors.FIELDS)
    return out + f""",
won AS (SELECT config_hash, usr, f, v FROM (SELECT s.config_hash, s.usr, s.f, s.v, round(sum(coalesce(weight, 1)), 9) AS w, min(k) AS k FROM s LEFT JOIN w{rounds} USING (src) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY config_hash, usr, f ORDER BY w DESC, k) = 1),
wide AS (SELECT config_hash, usr, {columns} FROM won GROUP BY 1, 2)
SELECT r.config_hash, r.usr, several, id AS best_id, {", ".join(f"wide.{f}" for f in survivors.FIELDS)} FROM r LEFT JOIN wide USING (config_hash, usr) WHERE k = 1"""


SQL["p6_survivors"] = _survivor_sql()
