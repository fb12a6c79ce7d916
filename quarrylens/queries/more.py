"""Queries of macros, ownership, rules, deletions and replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import merge as M
from quarrylens.operators import paging as P
from quarrylens.operators import pointsto as S
from quarrylens.operators import registry as R
from quarrylens.operators import stats as A
from quarrylens.queries.common import BOTH, SYM, ref, slot_facts, sym
from quarrylens.queries.lookup import _RUNS
from quarrylens.queries.search import SQL as SEARCH_SQL
from quarrylens.queries.search import retrieval_metrics
from quarrylens.queries.slots import _PT
from quarrylens.runtime import load

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _macros(spark, sf):
    """Bound to enum constants: their value is the macro's."""
    s = sym(spark, sf).where("kind = 'enum_constant'")
    return s.select("id", "config_hash", "file_id", "name", F.col("enum_value").cast("string").alias("value"), F.lit("").alias("params"), "line", F.lit(0).alias("is_function_like"))


@query(f"""WITH {SYM}, f AS (SELECT config_hash, id AS file_id, min(path) AS path FROM files GROUP BY 1, 2) SELECT s.config_hash, s.id, s.name, f.path, s.name AS label,
row_number() OVER (PARTITION BY s.config_hash ORDER BY s.name, s.line, s.file_id, s.id)::INT AS rn FROM sym s LEFT JOIN f ON f.config_hash = s.config_hash AND f.file_id = s.file_id
WHERE s.kind = 'enum_constant' AND starts_with(lower(s.name), 's') QUALIFY rn <= 100""")
def macro_lookup(spark, sf):
    return R.macro_lookup(_macros(spark, sf), load(spark, sf, "files"), "S", exact=False).select("config_hash", "id", "name", "path", "label", "rn")


@query(f"""WITH {BOTH}, m AS (SELECT id, config_hash, usr, file_path AS path, name, enum_value::VARCHAR AS value FROM sym WHERE kind = 'enum_constant'),
rd AS (SELECT DISTINCT r.config_hash, s.file_path AS path, r.from_file AS unit FROM rf r JOIN sym s ON s.config_hash = r.config_hash AND s.usr = r.to_usr WHERE s.file_path IN (SELECT path FROM m)),
an AS (SELECT DISTINCT r.config_hash, r.from_file AS unit, m.name, CASE WHEN r.ref_kind = 'indirect' THEN 'undefined' ELSE 'defined' END AS state, CASE WHEN r.ref_kind = 'indirect' THEN NULL ELSE m.value END AS value FROM rf r JOIN m ON m.config_hash = r.config_hash AND m.usr = r.to_usr),
t AS (SELECT m.id, coalesce(an.state, 'no_answer') AS state, an.value FROM m JOIN rd ON rd.config_hash = m.config_hash AND rd.path = m.path LEFT JOIN an ON an.config_hash = m.config_hash AND an.unit = rd.unit AND an.name = m.name),
c AS (SELECT id, state, value, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT id, sum(n)::BIGINT AS units, list(n || ' ' || state || coalesce(' ' || value, '') ORDER BY n DESC, state, value NULLS FIRST) AS states, CASE WHEN count(*) = 1 AND min(state) = 'defined' THEN min(value) END AS expanded_value FROM c GROUP BY 1)
SELECT m.id, coalesce(units, 0) AS units, coalesce(states, []) AS states, expanded_value FROM m LEFT JOIN p ON p.id = m.id""")
def macro_states(spark, sf):
    """Bound: macros are enum constants, a unit reads a file if it refers to a symbol of it, and knows the constants that it refers to, but not those it
    only reaches indirectly."""
    s, r = sym(spark, sf), ref(spark, sf)
    m = s.where("kind = 'enum_constant'").select("id", "config_hash", "usr", F.col("file_path").alias("path"), "name", F.col("enum_value").cast("string").alias("value"))
    to = r.select("config_hash", F.col("to_usr").alias("usr"), F.col("from_file").alias("unit"), "ref_kind")
    readers = to.join(s.select("config_hash", "usr", F.col("file_path").alias("path")), ["config_hash", "usr"]).select("config_hash", "path", "unit").distinct()
    known = to.join(m.select("config_hash", "usr", "name", "value"), ["config_hash", "usr"])
    indirect = F.col("ref_kind") == "indirect"
    answers = known.select("config_hash", "unit", "name", F.when(indirect, "undefined").otherwise("defined").alias("state"), F.when(~indirect, F.col("value")).alias("value"), F.lit("").alias("params"), F.lit(0).alias("is_function_like"))
    return R.macro_states(m, readers, answers)


@query(f"WITH {SYM} SELECT config_hash, count(*) AS macros FROM sym WHERE kind = 'enum_constant' GROUP BY 1")
def macro_count(spark, sf):
    return _macros(spark, sf).groupBy("config_hash").agg(F.count(F.lit(1)).alias("macros"))


@query(f"""WITH {SYM}, i AS (SELECT config_hash, template_usr, count(DISTINCT (file_path, line)) AS n, min({{'f': file_path, 'l': line}}) AS p, bool_or(is_project = 1) AS m FROM sym WHERE template_usr <> '' GROUP BY 1, 2)
SELECT config_hash, template_usr, p.f || ':' || p.l AS place FROM i WHERE n = 1 OR m""")
def template_places(spark, sf):
    """Merged: the templates with an instance in project code."""
    s = sym(spark, sf).where("template_usr <> ''")
    return R.template_places(s, s.where("is_project = 1"))


@query(f"""WITH {BOTH}, v AS (SELECT config_hash, name AS macro, min(enum_value) AS lo FROM symbols WHERE kind = 'enum_constant' AND enum_value IS NOT NULL GROUP BY 1, 2 HAVING min(enum_value) = max(enum_value)),
c AS (SELECT DISTINCT r.config_hash, s.name AS macro, r.from_usr AS handler FROM rf r JOIN sym s ON s.config_hash = r.config_hash AND s.usr = r.to_usr WHERE s.kind = 'enum_constant' AND r.from_usr IS NOT NULL)
SELECT DISTINCT c.config_hash, (v.lo + 16)::INT AS slot_index, c.handler FROM c JOIN v ON v.config_hash = c.config_hash AND v.macro = c.macro""")
def runtime_registrations(spark, sf):
    s = sym(spark, sf).where("kind = 'enum_constant'").select("config_hash", F.col("usr").alias("to_usr"), F.col("name").alias("macro"))
    calls = ref(spark, sf).where("from_usr is not null").join(s, ["config_hash", "to_usr"]).select("config_hash", "macro", F.col("from_usr").alias("handler")).distinct()
    values = load(spark, sf, "symbols").where("kind = 'enum_constant' and enum_value is not null").select("config_hash", F.col("name").alias("macro"), F.col("enum_value").alias("value"))
    return R.runtime_registrations(calls, values, 16)


def _links(spark, sf):
    rules = spark.createDataFrame([("sched_lock_enter", None, 0, "call", "rtos"), ("trace_emit", None, 0, "call", "log"), ("board_bringup_all", None, 0, "call", "bsp")], "entry_name string, callee_name string, slot_index int, kind string, sdk string")
    return S.sdk_links(sym(spark, sf), rules)


_LINKS = "l AS (SELECT s.config_hash, s.usr AS entry, 'P|' || s.usr || '|0' AS slot, CASE s.name WHEN 'sched_lock_enter' THEN 'rtos' WHEN 'trace_emit' THEN 'log' ELSE 'bsp' END AS sdk FROM sym s WHERE s.name IN ('sched_lock_enter', 'trace_emit', 'board_bringup_all'))"


@query(f"""WITH RECURSIVE {SYM}, {_PT}, {_LINKS}, w AS (SELECT config_hash, source AS a, target AS b FROM flow WHERE source <> target
UNION SELECT w.config_hash, w.a, f.target FROM w JOIN flow f ON f.config_hash = w.config_hash AND f.source = w.b WHERE f.source <> f.target),
inner_ AS (SELECT DISTINCT x.config_hash, x.slot, y.slot AS other FROM l x JOIN w ON w.config_hash = x.config_hash AND w.a = x.slot JOIN l y ON y.config_hash = x.config_hash AND y.slot = w.b AND y.slot <> x.slot),
outer_ AS (SELECT DISTINCT config_hash, slot FROM inner_ i WHERE NOT EXISTS (SELECT 1 FROM inner_ j WHERE j.config_hash = i.config_hash AND j.slot = i.other AND j.other = i.slot))
SELECT DISTINCT l.config_hash, l.entry AS from_usr, pt.function AS to_usr FROM l JOIN pt ON pt.config_hash = l.config_hash AND pt.slot = l.slot
WHERE NOT EXISTS (SELECT 1 FROM outer_ o WHERE o.config_hash = l.config_hash AND o.slot = l.slot)
AND NOT EXISTS (SELECT 1 FROM rf k WHERE k.config_hash = l.config_hash AND k.ref_kind = 'call' AND k.from_usr = l.entry AND k.to_usr = pt.function)""")
def sdk_edges(spark, sf):
    f = slot_facts(spark, sf)
    targets = S.resolve_slots(f["sources"], f["flows"], f["sites"]).targets
    return S.sdk_edges(_links(spark, sf), targets, f["flows"], ref(spark, sf).where("ref_kind = 'call' and from_usr is not null"))


@query(f"""WITH RECURSIVE {SYM}, {_PT}, {_LINKS}, e AS (SELECT DISTINCT config_hash, from_usr, to_usr FROM rf WHERE ref_kind = 'call' AND from_usr IS NOT NULL),
b AS (SELECT e.*, l.sdk FROM e JOIN l ON l.config_hash = e.config_hash AND l.entry = e.from_usr
UNION SELECT e.*, l.sdk FROM e JOIN pt ON pt.config_hash = e.config_hash AND pt.function = e.to_usr JOIN l ON l.config_hash = pt.config_hash AND l.slot = pt.slot)
SELECT config_hash, from_usr, to_usr, array_to_string(list_sort(list(sdk)), '; ') AS entries FROM b GROUP BY 1, 2, 3""")
def sdk_entries(spark, sf):
    f = slot_facts(spark, sf)
    targets = S.resolve_slots(f["sources"], f["flows"], f["sites"]).targets
    edges = ref(spark, sf).where("ref_kind = 'call' and from_usr is not null").select("config_hash", "from_usr", "to_usr").distinct()
    return R.sdk_entries(edges, _links(spark, sf), targets)


@query(f"""WITH {BOTH}, gone AS (SELECT DISTINCT config_hash, path FROM files WHERE contains(path, 'vendor')),
lost AS (SELECT s.config_hash, s.usr FROM sym s SEMI JOIN gone g ON g.config_hash = s.config_hash AND g.path = s.file_path)
SELECT 'symbols' AS kind, id FROM sym s ANTI JOIN gone g ON g.config_hash = s.config_hash AND g.path = s.file_path
UNION ALL SELECT 'refs', id FROM rf r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.config_hash = r.config_hash AND g.path = r.from_file)
AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.config_hash = r.config_hash AND l.usr = r.to_usr)""")
def files_deleted(spark, sf):
    gone = load(spark, sf, "files").where("path like '%vendor%'").select("config_hash", "path").distinct()
    s, r = M.delete_files(sym(spark, sf), ref(spark, sf), gone)
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("kind"), "id") for n, df in (("symbols", s), ("refs", r))])


@query(f"""WITH {SYM}, f AS (SELECT config_hash, file_path FROM sym WHERE is_definition = 0) SELECT config_hash, usr, id FROM sym WHERE (config_hash, file_path) NOT IN (SELECT config_hash, file_path FROM f)
UNION ALL SELECT config_hash, usr, -id FROM sym WHERE is_definition = 0""")
def files_replaced(spark, sf):
    s = sym(spark, sf).select("config_hash", "file_path", "usr", "id", "is_definition")
    fresh = s.where("is_definition = 0").withColumn("id", -F.col("id"))
    return M.replace_files(s, fresh, ["config_hash", "file_path"]).select("config_hash", "usr", "id")


@query(f"WITH {SYM}, b AS (SELECT min(config_hash) AS h FROM sym) SELECT config_hash, usr FROM sym WHERE config_hash <> (SELECT h FROM b)")
def build_deleted(spark, sf):
    s = sym(spark, sf)
    return M.delete_build({"symbols": s}, s.agg(F.min("config_hash")).first()[0])["symbols"].select("config_hash", "usr")


@query("""WITH c AS (SELECT DISTINCT f.config_hash, h.path AS header, f.path AS unit_path, f.language, f.flags_hash FROM files f JOIN files h ON h.config_hash = f.config_hash
AND regexp_extract(h.path, '^(.*)/', 1) = regexp_extract(f.path, '^(.*)/', 1) WHERE regexp_matches(h.path, '\\.h(pp|h)?$') AND NOT regexp_matches(f.path, '\\.h(pp|h)?$'))
SELECT config_hash, header, arg_min(unit_path, {'o': language <> 'cpp', 'u': unit_path, 'f': coalesce(flags_hash, '')}) AS unit FROM c GROUP BY 1, 2""")
def header_owners(spark, sf):
    f = load(spark, sf, "files").select("config_hash", "path", "language", F.coalesce("flags_hash", F.lit("")).alias("flags_hash"), F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct()
    header = F.col("path").rlike(r"\.h(pp|h)?$")
    claims = f.where(~header).withColumnRenamed("path", "unit_path").join(f.where(header).select("config_hash", "folder", F.col("path").alias("header")).distinct(), ["config_hash", "folder"])
    return M.header_owners(claims)


@query(f"""WITH {SYM}, {_RUNS}, top AS (SELECT config_hash, max(run_no) AS run_no FROM ok GROUP BY 1), a AS (SELECT DISTINCT n.config_hash, path, content_hash FROM now_ n JOIN top t ON t.config_hash = n.config_hash AND t.run_no = n.run_no),
b AS (SELECT DISTINCT n.config_hash, path, content_hash FROM was_ n JOIN top t ON t.config_hash = n.config_hash AND t.run_no = n.run_no),
st AS (SELECT DISTINCT a.config_hash, a.path FROM a JOIN b ON b.config_hash = a.config_hash AND b.path = a.path WHERE a.content_hash <> b.content_hash)
SELECT s.config_hash, s.usr, st.path IS NOT NULL AS stale FROM sym s LEFT JOIN st ON st.config_hash = s.config_hash AND st.path = s.file_path""")
def stale_flags(spark, sf):
    """Stale: the newest good run of the build found another content than the good run before it."""
    runs = load(spark, sf, "index_runs")
    now, was = M.against_last(load(spark, sf, "files"), runs)
    newest = runs.where("state = 'ok'").groupBy("config_hash").agg(F.max("run_no").alias("run_no"))
    both = was.select("config_hash", "run_no", "path", F.col("content_hash").alias("was")).join(now.select("config_hash", "run_no", "path", "content_hash"), ["config_hash", "run_no", "path"]).join(newest, ["config_hash", "run_no"])
    return M.annotate_stale(sym(spark, sf), both.where("was <> content_hash").select("config_hash", "path")).select("config_hash", "usr", "stale")


@query("SELECT DISTINCT id, run_no, CASE WHEN starts_with(path, 'app/') OR starts_with(path, 'lib/') THEN 1 ELSE is_project END AS is_project FROM files")
def project_realigned(spark, sf):
    return M.align_is_project(load(spark, sf, "files"), ["app/", "lib/"]).select("id", "run_no", "is_project").distinct()


@query("SELECT DISTINCT from_file AS path FROM refs WHERE from_file NOT IN (SELECT path FROM files WHERE generated = 0 AND is_project = 1)")
def unindexed_sources(spark, sf):
    """Bound so that there are some: on disk is what references stand in, listed are the project's own files."""
    return M.unindexed_sources(load(spark, sf, "refs").select(F.col("from_file").alias("path")).distinct(), load(spark, sf, "files").where("generated = 0 and is_project = 1"))


@query(f"""WITH {SYM}, a AS (SELECT DISTINCT s.config_hash, 'x' || s.usr AS alias, s.name, s.file_path AS decl_file, s.line, s.signature FROM sym s WHERE s.kind = 'function' AND s.is_definition = 1),
one AS (SELECT config_hash, alias, min(decl_file) AS f, min(name) AS name, min(signature) AS sig FROM a GROUP BY 1, 2 HAVING count(DISTINCT (decl_file, line)) = 1 AND min(signature) = max(signature)),
d AS (SELECT config_hash, file_path, name, min(usr) AS usr, min(signature) AS sig FROM sym WHERE is_definition = 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT usr) = 1)
SELECT o.config_hash, o.alias, d.usr FROM one o JOIN d ON d.config_hash = o.config_hash AND d.file_path = o.f AND d.name = o.name AND d.sig = o.sig""")
def internal_unified(spark, sf):
    s = sym(spark, sf)
    a = s.where("kind = 'function' and is_definition = 1").select("config_hash", F.concat(F.lit("x"), "usr").alias("alias"), "name", F.col("file_path").alias("decl_file"), "line", "signature")
    return S.unify_internal(a, s)


@query(f"""WITH {BOTH} SELECT 'a' AS part, id FROM (SELECT id FROM sym WHERE kind = 'enum' ORDER BY id OFFSET 3) UNION ALL SELECT 'b', id FROM (SELECT id FROM sym WHERE kind = 'union' ORDER BY id LIMIT 40)""")
def page_over_parts(spark, sf):
    s = sym(spark, sf)
    n = s.where("kind = 'enum'").count()
    parts = [(s.where(f"kind = '{k}'").select(F.lit(p).alias("part"), "id"), [F.col("id")]) for p, k in (("a", "enum"), ("b", "union"))]
    return reduce(DataFrame.unionByName, P.page_parts(parts, n - 3 + 40, 3))


@query(f"WITH m AS ({SEARCH_SQL['retrieval_metrics']}) SELECT " + ", ".join(f"avg({c}) AS {c}" for c in ("mrr", "recall1", "recall10", "precision5", "ndcg10")) + " FROM m")
def metric_averages(spark, sf):
    return A.average_metrics(retrieval_metrics(spark, sf))


@query(f"""WITH m AS ({SEARCH_SQL['retrieval_metrics']}), v AS (SELECT *, query % 100 = 0 AS even FROM m), a AS (SELECT avg(mrr) AS mrr, avg(recall10) AS recall10 FROM v WHERE even), b AS (SELECT avg(mrr) AS mrr, avg(recall10) AS recall10 FROM v WHERE NOT even)
SELECT 'mrr' AS metric, a.mrr AS a, b.mrr AS b, b.mrr - a.mrr AS gain FROM a, b UNION ALL SELECT 'recall10', a.recall10, b.recall10, b.recall10 - a.recall10 FROM a, b""")
def metric_comparison(spark, sf):
    """Two variants, bound to the queries with an even and an odd multiple of 50."""
    m = retrieval_metrics(spark, sf)
    return A.compare_metrics(m.where("query % 100 = 0"), m.where("query % 100 <> 0"), ["mrr", "recall10"])


@query(f"""WITH m AS ({SEARCH_SQL['retrieval_metrics']}), g AS (SELECT CASE WHEN query % 100 = 0 THEN 'even' ELSE 'odd' END AS variant, avg(mrr) AS mrr, avg(recall10) AS recall10 FROM m GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY mrr DESC, variant)::INT AS rank FROM g""")
def metric_grid(spark, sf):
    m = retrieval_metrics(spark, sf).withColumn("variant", F.when(F.col("query") % 100 == 0, "even").otherwise("odd"))
    return A.metric_grid(m, ["variant"], "mrr").select("variant", "mrr", "recall10", "rank")


@query("""WITH t AS (SELECT DISTINCT id, kind, unnest(list_distinct(string_split(name_tokens, ' '))) AS term FROM (SELECT DISTINCT ON (id) * FROM symbols ORDER BY id)), n AS (SELECT kind, count(DISTINCT id) AS rows FROM symbols GROUP BY 1),
c AS (SELECT kind, term, count(*) AS n FROM t WHERE term <> '' GROUP BY 1, 2)
SELECT c.kind, c.term, c.n, row_number() OVER (PARTITION BY c.kind ORDER BY c.n DESC, c.term)::INT AS rank FROM c JOIN n ON n.kind = c.kind WHERE c.n <= greatest(n.rows * 0.2, 1) QUALIFY row_number() OVER (PARTITION BY c.kind ORDER BY c.n DESC, c.term) <= 10""")
def sampled_terms(spark, sf):
    return R.sample_terms(load(spark, sf, "symbols").dropDuplicates(["id"]), "kind", "name_tokens")
