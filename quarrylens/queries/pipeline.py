"""Queries of the general problems 1, 2, 3 and 7, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import hierarchy as H
from quarrylens.operators import increment as I
from quarrylens.operators import orphans as O
from quarrylens.operators import skew as K
from quarrylens.runtime import load, scratch_path


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(load(spark, sf_dir, "symbols"), paths=False)
    return H.cycles(tree).select("config_hash", "usr", F.col("cycle").alias("cycle_usr"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(load(spark, sf_dir, "symbols"))
    return tree.select("config_hash", "usr", "root", "depth", "cycle", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(H.hierarchy(load(spark, sf_dir, "symbols")))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_references(load(spark, sf_dir, "refs"), load(spark, sf_dir, "symbols"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_id", "side", "state")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_report(_orphans(spark, sf_dir), "refs")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = K.heavy_keys(load(spark, sf_dir, "refs"), ["to_usr", "from_usr"])
    return heavy.select("field_name", F.col("value").alias("usr"))


def p3_usr_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.usr_profile(load(spark, sf_dir, "refs"))


def _p7(spark: SparkSession, sf_dir: str, steps: int, crash: int | None = None) -> DataFrame:
    """All listings through one store in so many deliveries by the time that they arrived, each followed by an incremental
    run; the run numbered crash dies once before its commit."""
    store = I.CommitStore(spark, scratch_path(spark, "p7-store"))
    files, runs = load(spark, sf_dir, "files"), load(spark, sf_dir, "index_runs")
    first, last = (t or 0 for t in files.agg(F.unix_micros(F.min("seen_at")), F.unix_micros(F.max("seen_at"))).first())
    ends = [F.timestamp_micros(F.lit(first + (last - first) * i // steps)) for i in range(1, steps)]
    for i in range(steps):
        def arrived(when, i=i):
            late = when > ends[i - 1] if i else F.lit(True)
            early = F.lit(True) if i == steps - 1 else when <= ends[i] if i else (when <= ends[i]) | when.isNull()
            return late & early
        I.deliver_files(store, f"arrived-{i}", files.where(arrived(F.col("seen_at"))), runs.where(arrived(F.coalesce("finished_at", "started_at"))))

        def die():
            raise OSError("lost")
        if i == crash:
            try:
                I.process_news(store, before_commit=die)
            except OSError:
                pass
        I.process_news(store)
    return store.committed().select("file_id", "run_no").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir, 3)


def p7_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir, 5, crash=3)


QUERIES = {
    "p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p2_found": p2_found,
    "p2_report": p2_report, "p3_found": p3_found, "p3_usr_profile": p3_usr_profile, "p7_found": p7_found, "p7_increments": p7_increments,
}

_LINKS = """
links AS (SELECT config_hash, usr, max(nullif(parent_usr, '')) AS up FROM symbols
          WHERE config_hash IS NOT NULL AND usr <> '' GROUP BY 1, 2),
up AS (SELECT l.config_hash, l.usr, l.up FROM links l JOIN links p ON p.config_hash = l.config_hash AND p.usr = l.up),
above AS (SELECT config_hash, usr, up AS a FROM up
          UNION SELECT x.config_hash, x.usr, u.up FROM above x JOIN up u ON u.config_hash = x.config_hash AND u.usr = x.a),
ring AS (SELECT config_hash, usr FROM above WHERE usr = a),
caught AS (SELECT x.config_hash, x.usr, min(r.usr) AS cycle_usr
           FROM (SELECT config_hash, usr, a FROM above UNION SELECT config_hash, usr, usr FROM ring) x
           JOIN ring r ON r.config_hash = x.config_hash AND r.usr = x.a GROUP BY 1, 2)"""

_ORPHANS = """
keys AS (SELECT config_hash, usr, min(seen_at) AS born,
                CASE WHEN count(*) = count(removed_at) THEN max(removed_at) END AS gone FROM symbols GROUP BY 1, 2),
sides AS (SELECT id, config_hash, seen_at, 'to' AS side, to_usr AS usr FROM refs
          UNION ALL SELECT id, config_hash, seen_at, 'from', from_usr FROM refs),
found AS (SELECT DISTINCT s.id AS ref_id, s.side, s.seen_at,
                 CASE WHEN k.usr IS NULL THEN 'missing' WHEN s.seen_at < k.born THEN 'late'
                      WHEN s.seen_at >= k.gone THEN 'deleted' END AS state, s.config_hash, s.usr
          FROM sides s LEFT JOIN keys k ON k.config_hash = s.config_hash AND k.usr = s.usr WHERE s.usr <> '')"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT config_hash, usr, cycle_usr FROM caught",
    "p1_hierarchy": f"""WITH RECURSIVE {_LINKS},
tree AS (SELECT l.config_hash, l.usr, l.usr AS root, 0 AS depth, l.usr AS path FROM links l
         WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.config_hash = l.config_hash AND u.usr = l.usr)
         UNION ALL SELECT u.config_hash, u.usr, t.root, t.depth + 1, t.path || ' > ' || u.usr
         FROM tree t JOIN up u ON u.config_hash = t.config_hash AND u.up = t.usr)
SELECT config_hash, usr, root, depth, CAST(NULL AS VARCHAR) AS cycle, path FROM tree
UNION ALL SELECT config_hash, usr, NULL, NULL, cycle_usr, '' FROM caught""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
walk AS (SELECT config_hash, up AS ancestor, usr, 1 AS distance FROM up
         WHERE NOT EXISTS (SELECT 1 FROM caught c WHERE c.config_hash = up.config_hash AND c.usr = up.usr)
         UNION ALL SELECT w.config_hash, u.up, w.usr, w.distance + 1
         FROM walk w JOIN up u ON u.config_hash = w.config_hash AND u.usr = w.ancestor)
SELECT config_hash, ancestor, usr, distance FROM walk""",
    "p2_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_id, side, state FROM found WHERE state IS NOT NULL",
    "p2_report": f"""WITH {_ORPHANS} SELECT 'refs' AS table_name, side, state, strftime(seen_at, '%Y-%m') AS month,
count(*) AS n_refs FROM found WHERE state IS NOT NULL GROUP BY ALL""",
    "p3_found": """SELECT field_name, usr FROM (
SELECT 'to_usr' AS field_name, to_usr AS usr, count(*) AS n FROM refs GROUP BY to_usr
UNION ALL SELECT 'from_usr', from_usr, count(*) FROM refs GROUP BY from_usr)
WHERE usr <> '' AND n >= 0.02 * (SELECT count(*) FROM refs)""",
    "p3_usr_profile": """SELECT usr, sum(sites)::BIGINT AS sites, sum(callers)::BIGINT AS callers,
sum(calls_made)::BIGINT AS calls_made, sum(callees)::BIGINT AS callees FROM (
SELECT to_usr AS usr, count(*) AS sites, count(DISTINCT nullif(from_usr, '')) AS callers, 0 AS calls_made, 0 AS callees
FROM refs WHERE to_usr <> '' GROUP BY to_usr
UNION ALL SELECT from_usr, 0, 0, count(*), count(DISTINCT nullif(to_usr, '')) FROM refs WHERE from_usr <> '' GROUP BY from_usr)
GROUP BY usr""",
    "p7_found": """WITH ok AS (SELECT DISTINCT f.config_hash, f.id, f.run_no, f.source_hash, f.flags_hash
FROM files f JOIN index_runs r ON r.config_hash = f.config_hash AND r.run_no = f.run_no WHERE r.state = 'ok'),
prev AS (SELECT *, lag(source_hash) OVER w AS s, lag(flags_hash) OVER w AS g, row_number() OVER w AS k FROM ok
         WINDOW w AS (PARTITION BY config_hash, id ORDER BY run_no))
SELECT id AS file_id, run_no FROM prev WHERE k = 1 OR NOT coalesce(
nullif(s, '') = nullif(source_hash, '') AND nullif(g, '') = nullif(flags_hash, ''), false)""",
}
SQL["p7_increments"] = SQL["p7_found"]
