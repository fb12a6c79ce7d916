"""Queries of lookups, joins, intervals, graphs, aggregates and merges over the merged tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import callgraph as G
from quarrylens.operators import intervals as V
from quarrylens.operators import merge as M
from quarrylens.operators import paging as P
from quarrylens.operators import references as R
from quarrylens.operators import resolve as L
from quarrylens.operators import stats as A
from quarrylens.queries.common import BOTH, EDGES, INH, OVR, REF, SYM, inheritance, overrides, ref, sym
from quarrylens.runtime import load, scratch_path
from quarrylens.sources.sinks import read_table, replace_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


ORDER = "PARTITION BY config_hash ORDER BY"


# --- names and lookups

@query(f"""WITH {BOTH}, m AS (SELECT *, CASE WHEN name = 'good' THEN 1 WHEN ends_with(qualified_name, '::good') OR qualified_name = 'good' THEN 2 END AS match_rank FROM sym),
b AS (SELECT * FROM m WHERE match_rank IS NOT NULL QUALIFY match_rank = min(match_rank) OVER (PARTITION BY config_hash)),
i AS (SELECT config_hash, to_usr AS usr, count(*) AS n FROM rf GROUP BY 1, 2), o AS (SELECT config_hash, from_usr AS usr, count(*) AS n FROM rf GROUP BY 1, 2)
SELECT b.config_hash, b.usr, match_rank, coalesce(i.n, 0) AS ref_count, coalesce(o.n, 0) AS out_count,
row_number() OVER (PARTITION BY b.config_hash ORDER BY match_rank, is_definition DESC, is_project DESC, coalesce(i.n, 0) DESC, coalesce(o.n, 0) DESC, b.usr)::INT AS rn
FROM b LEFT JOIN i ON i.config_hash = b.config_hash AND i.usr = b.usr LEFT JOIN o ON o.config_hash = b.config_hash AND o.usr = b.usr""")
def resolve_rank(spark, sf):
    return L.resolve(sym(spark, sf), ref(spark, sf), "good").select("config_hash", "usr", "match_rank", "ref_count", "out_count", "rn")


@query(f"""WITH {SYM} SELECT config_hash, count(DISTINCT usr) AS candidates FROM sym WHERE name = 'good' GROUP BY 1""")
def resolve_count(spark, sf):
    return L.resolve(sym(spark, sf), ref(spark, sf), "good").groupBy("config_hash").agg(F.countDistinct("usr").alias("candidates"))


@query(f"""WITH {SYM}, r AS (SELECT *, row_number() OVER ({ORDER} is_definition DESC, line, file_path, usr)::INT AS rn FROM sym WHERE name = 'good' OR qualified_name = 'good')
SELECT r.config_hash, r.usr, r.name, r.kind, r.file_path, r.line, r.rn, coalesce(p.name, '') AS owner FROM r LEFT JOIN sym p ON p.config_hash = r.config_hash AND p.usr = r.parent_usr AND p.kind IN ('class', 'struct', 'union') WHERE rn <= 100""")
def lookup_exact(spark, sf):
    s = sym(spark, sf)
    return L.with_owner(L.lookup(s, "good"), s).select("config_hash", "usr", "name", "kind", "file_path", "line", "rn", "owner")


@query(f"""WITH {SYM} SELECT config_hash, usr, name, row_number() OVER ({ORDER} is_definition DESC, line, file_path, usr)::INT AS rn
FROM sym WHERE starts_with(lower(name), 'spi_') OR starts_with(lower(qualified_name), 'spi_') QUALIFY rn <= 100""")
def lookup_prefix(spark, sf):
    return L.lookup(sym(spark, sf), "SPI_", exact=False).select("config_hash", "usr", "name", "rn")


@query(f"""WITH {SYM}, t AS (SELECT *, CASE WHEN name = 'good' THEN 0 WHEN qualified_name = 'good' THEN 1 WHEN ends_with(qualified_name, '::good') THEN 2 END AS tier FROM sym)
SELECT config_hash, usr, qualified_name, is_definition FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER ({ORDER} is_definition DESC, tier,
starts_with(usr, 'asm:'), kind NOT IN ('function', 'method', 'constructor', 'destructor'), is_project DESC, line, usr) = 1""")
def lookup_definition(spark, sf):
    return L.lookup_definition(sym(spark, sf), "good").select("config_hash", "usr", "qualified_name", "is_definition")


@query(f"""WITH {SYM}, r AS (SELECT config_hash, link_name, usr, CASE WHEN is_definition = 1 AND is_weak = 0 THEN 0
WHEN is_weak = 1 AND NOT starts_with(usr, 'ld:') THEN 1 WHEN is_weak = 1 THEN 2 ELSE 3 END AS k FROM sym WHERE link_name <> ''),
b AS (SELECT * FROM r QUALIFY k = min(k) OVER (PARTITION BY config_hash, link_name))
SELECT config_hash, link_name, min(usr) AS usr, k AS link_rank FROM b GROUP BY config_hash, link_name, k HAVING count(DISTINCT usr) = 1""")
def link_rank_resolution(spark, sf):
    return L.link_definition(sym(spark, sf))


@query(f"""WITH {SYM} SELECT config_hash, usr, CASE WHEN count(*) OVER (PARTITION BY config_hash, qualified_name) = 1 THEN qualified_name
WHEN count(*) OVER (PARTITION BY config_hash, qualified_name, file_path) = 1 THEN qualified_name || ' (' || file_path || ')'
ELSE qualified_name || regexp_extract(coalesce(signature, ''), '(\\(.*\\))', 1) || ' (' || file_path || ')' END AS label, count(*) OVER (PARTITION BY config_hash, qualified_name) AS ambiguous FROM sym""")
def candidate_labels(spark, sf):
    return L.candidate_labels(sym(spark, sf)).select("config_hash", "usr", "label", "ambiguous")


@query(f"""WITH {BOTH}, top AS (SELECT name AS q FROM sym GROUP BY config_hash, name ORDER BY count(*) DESC, name LIMIT 1),
m AS (SELECT sym.*, CASE WHEN name = q THEN 1 WHEN ends_with(qualified_name, '::' || q) OR qualified_name = q THEN 2 END AS match_rank FROM sym, top),
b AS (SELECT * FROM m WHERE match_rank IS NOT NULL QUALIFY match_rank = min(match_rank) OVER (PARTITION BY config_hash)),
i AS (SELECT config_hash, to_usr AS usr, count(*) AS n FROM rf GROUP BY 1, 2), o AS (SELECT config_hash, from_usr AS usr, count(*) AS n FROM rf GROUP BY 1, 2),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.config_hash ORDER BY match_rank, is_definition DESC, is_project DESC, coalesce(i.n, 0) DESC, coalesce(o.n, 0) DESC, b.usr) AS rn
FROM b LEFT JOIN i ON i.config_hash = b.config_hash AND i.usr = b.usr LEFT JOIN o ON o.config_hash = b.config_hash AND o.usr = b.usr),
l AS (SELECT config_hash, rn, CASE WHEN count(*) OVER (PARTITION BY config_hash, qualified_name) = 1 THEN qualified_name
WHEN count(*) OVER (PARTITION BY config_hash, qualified_name, file_path) = 1 THEN qualified_name || ' (' || file_path || ')'
ELSE qualified_name || regexp_extract(coalesce(signature, ''), '(\\(.*\\))', 1) || ' (' || file_path || ')' END AS label FROM r)
SELECT config_hash, count(*) AS candidates, string_agg(label, '; ' ORDER BY rn) FILTER (WHERE rn <= 5) AS notice FROM l GROUP BY 1 HAVING count(*) > 1""")
def ambiguity_notice(spark, sf):
    """Of the name that most symbols of a build share."""
    s = sym(spark, sf)
    name = s.groupBy("config_hash", "name").count().orderBy(F.desc("count"), "name").first()["name"]
    return L.ambiguity_notice(L.resolve(s, ref(spark, sf), name))


@query(f"""WITH {SYM} SELECT v.config_hash, v.usr, v.name, p.qualified_name AS parent_name FROM sym v
LEFT JOIN sym p ON p.config_hash = v.config_hash AND p.usr = v.parent_usr
WHERE v.is_definition = 1 AND v.kind IN ('varglobal', 'varlocal', 'variable') AND contains(lower(v.name), 'a')""")
def find_variables(spark, sf):
    return L.find_variables(sym(spark, sf), "A").select("config_hash", "usr", "name", "parent_name")


@query(f"""WITH {SYM} SELECT config_hash, file_path, kind, usr, count(*) OVER w AS kind_total, row_number() OVER (w ORDER BY line, col, usr)::INT AS rn
FROM sym WINDOW w AS (PARTITION BY config_hash, file_path, kind) QUALIFY row_number() OVER (w ORDER BY line, col, usr) <= 3""")
def file_map_capped(spark, sf):
    return L.file_map(sym(spark, sf), 3).select("config_hash", "file_path", "kind", "usr", "kind_total", "rn")


@query(f"""WITH {SYM}, top AS (SELECT file_path FROM sym WHERE kind = 'enum_constant' GROUP BY 1 ORDER BY count(*) DESC, file_path LIMIT 1)
SELECT s.config_hash, s.usr, s.name, e.name AS enum_name FROM sym s LEFT JOIN sym e ON e.config_hash = s.config_hash AND e.usr = s.parent_usr AND e.kind = 'enum'
WHERE s.kind = 'enum_constant' AND s.file_path = (SELECT file_path FROM top) ORDER BY s.config_hash, s.line, s.col, s.usr LIMIT 20 OFFSET 2""")
def file_map_kind_page(spark, sf):
    s = sym(spark, sf)
    top = s.where("kind = 'enum_constant'").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").first()[0]
    return L.file_map_kind(s, top, "enum_constant", 20, 2).select("config_hash", "usr", "name", "enum_name")


@query(f"""WITH {SYM}, c AS (SELECT config_hash, parent_usr AS usr, list(name ORDER BY line, col, name) AS constants FROM sym WHERE kind = 'enum_constant' GROUP BY 1, 2)
SELECT e.config_hash, e.file_path, e.usr, coalesce(c.constants, []) AS constants FROM sym e LEFT JOIN c ON c.config_hash = e.config_hash AND c.usr = e.usr WHERE e.kind = 'enum'""")
def file_map_enums(spark, sf):
    return L.file_map_enums(sym(spark, sf))


@query("""WITH f AS (SELECT DISTINCT id, config_hash, path, CASE WHEN path = 'er.c' THEN 0 WHEN ends_with(lower(path), 'er.c') THEN 1 END AS k FROM files)
SELECT DISTINCT config_hash, path, k AS path_rank FROM f WHERE k IS NOT NULL QUALIFY k = min(k) OVER (PARTITION BY config_hash)""")
def path_match(spark, sf):
    return L.match_path(load(spark, sf, "files"), "er.c").select("config_hash", "path", "path_rank").distinct()


@query(f"""WITH {SYM} SELECT config_hash, usr FROM sym WHERE is_project = 1 AND NOT contains(lower(file_path), 'vendor/') AND NOT contains(lower(file_path), '.hpp')""")
def project_filter(spark, sf):
    return L.project_filter(sym(spark, sf), True, ("vendor/", ".hpp")).select("config_hash", "usr")


@query(f"""WITH {SYM}, top AS (SELECT parent_usr FROM sym WHERE parent_usr <> '' GROUP BY 1 ORDER BY count(*) DESC, parent_usr LIMIT 1)
SELECT config_hash, usr, kind, name, line FROM sym WHERE parent_usr = (SELECT parent_usr FROM top)""")
def class_members(spark, sf):
    s = sym(spark, sf)
    top = s.where("parent_usr <> ''").groupBy("parent_usr").count().orderBy(F.desc("count"), "parent_usr").first()[0]
    return L.class_members(s, top).select("config_hash", "usr", "kind", "name", "line")


@query(f"""WITH {SYM} SELECT config_hash, template_usr, usr, file_path, line FROM sym WHERE template_usr <> ''""")
def template_instances(spark, sf):
    return L.template_instances(sym(spark, sf)).select("config_hash", "template_usr", "usr", "file_path", "line")


@query(f"""WITH {SYM}, e AS (SELECT qualified_name AS q FROM sym WHERE kind = 'enum_constant' AND contains(qualified_name, '::') ORDER BY qualified_name LIMIT 1)
SELECT config_hash, usr, enum_value FROM sym WHERE kind = 'enum_constant' AND starts_with(qualified_name, (SELECT regexp_replace(q, '::[^:]*$', '') FROM e) || '::')
ORDER BY line, usr LIMIT 200""")
def enum_constants(spark, sf):
    s = sym(spark, sf)
    first = s.where("kind = 'enum_constant' and qualified_name like '%::%'").orderBy("qualified_name").first()["qualified_name"]
    return L.enum_constants(s, first.rsplit("::", 1)[0]).select("config_hash", "usr", "enum_value")


@query()
def did_you_mean(spark, sf):
    return L.suggest(sym(spark, sf), "spi_haltt_cel")


@query(f"""WITH {SYM} SELECT config_hash, usr, (line + i - 1)::INT AS line_no, string_split(source, chr(10))[i] AS text
FROM (SELECT *, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS i FROM sym WHERE source IS NOT NULL)""")
def source_lines(spark, sf):
    return L.source_lines(sym(spark, sf))


@query("""SELECT doc_id, list_slice(string_split(text, chr(10)), 2, 4) AS lines FROM documents WHERE text IS NOT NULL""")
def file_lines_page(spark, sf):
    return L.file_page(load(spark, sf, "documents").where("text is not null"), 2, 3, "text").select("doc_id", "lines")


@query(f"""WITH {BOTH}, own AS (SELECT config_hash, usr FROM sym WHERE name = 'trace_emit'), c AS (SELECT unnest(['call', 'indirect', 'implicit_construct']) AS k)
SELECT 'callers' AS section, config_hash, count(*) AS total FROM rf r SEMI JOIN own o ON o.config_hash = r.config_hash AND o.usr = r.to_usr WHERE ref_kind IN (FROM c) GROUP BY 2
UNION ALL SELECT 'callees', config_hash, count(*) FROM rf r SEMI JOIN own o ON o.config_hash = r.config_hash AND o.usr = r.from_usr WHERE ref_kind IN (FROM c) GROUP BY 2
UNION ALL SELECT 'indirect', config_hash, count(*) FROM rf r SEMI JOIN own o ON o.config_hash = r.config_hash AND o.usr = r.to_usr WHERE ref_kind = 'indirect' GROUP BY 2
UNION ALL SELECT 'members', config_hash, count(*) FROM sym r SEMI JOIN own o ON o.config_hash = r.config_hash AND o.usr = r.parent_usr GROUP BY 2""")
def symbol_context(spark, sf):
    return L.context_counts(sym(spark, sf), ref(spark, sf), "trace_emit")


@query(f"""WITH {BOTH}, {OVR}, own AS (SELECT config_hash, usr FROM sym WHERE name = 'trace_emit' OR name = 'good'), e AS (SELECT * FROM rf WHERE ref_kind IN ('call', 'indirect', 'implicit_construct') AND from_usr IS NOT NULL),
r AS (SELECT 'body' AS section, config_hash, usr, usr AS other_usr FROM sym WHERE source IS NOT NULL UNION SELECT 'callers', config_hash, to_usr, from_usr FROM e UNION SELECT 'callees', config_hash, from_usr, to_usr FROM e
UNION SELECT 'indirect', config_hash, to_usr, from_usr FROM e WHERE ref_kind = 'indirect' UNION SELECT 'overrides', config_hash, derived_usr, base_usr FROM ovr UNION SELECT 'overridden_by', config_hash, base_usr, derived_usr FROM ovr
UNION SELECT 'members', config_hash, parent_usr, usr FROM sym WHERE kind <> 'enum_constant' UNION SELECT 'constants', config_hash, parent_usr, usr FROM sym WHERE kind = 'enum_constant'),
m AS (SELECT r.*, s.qualified_name AS other_name FROM r SEMI JOIN own o ON o.config_hash = r.config_hash AND o.usr = r.usr LEFT JOIN sym s ON s.config_hash = r.config_hash AND s.usr = r.other_usr)
SELECT section, config_hash, usr, other_usr, other_name, count(*) OVER (PARTITION BY section, config_hash, usr) AS total, row_number() OVER (PARTITION BY section, config_hash, usr ORDER BY other_name NULLS FIRST, other_usr)::INT AS rn FROM m QUALIFY rn <= 5""")
def symbol_sections(spark, sf):
    s, r, o = sym(spark, sf), ref(spark, sf), overrides(spark, sf)
    return L.context_sections(s, r, o, "trace_emit").unionByName(L.context_sections(s, r, o, "good"))


# --- references

@query(f"""WITH {BOTH} SELECT r.id, r.config_hash, r.from_usr, c.qualified_name AS caller_qualified_name, r.ref_kind FROM rf r
LEFT JOIN sym c ON c.config_hash = r.config_hash AND c.usr = r.from_usr WHERE r.to_usr = 'c:@F@trace_emit'""")
def refs_with_caller(spark, sf):
    return R.refs_of(ref(spark, sf), sym(spark, sf), "c:@F@trace_emit").select("id", "config_hash", "from_usr", "caller_qualified_name", "ref_kind")


@query(f"""WITH {BOTH} SELECT r.config_hash, c.qualified_name AS caller_qualified_name, r.from_file, r.from_line, min(r.from_col) AS from_col, bit_or(r.origins) AS origins
FROM rf r LEFT JOIN sym c ON c.config_hash = r.config_hash AND c.usr = r.from_usr
WHERE r.to_usr = 'c:@N@hal@S@Outcome' OR (r.to_usr >= 'c:@N@hal@S@Outcome@' AND r.to_usr < 'c:@N@hal@S@OutcomeA') GROUP BY ALL""")
def refs_of_type(spark, sf):
    return R.refs_of_type(ref(spark, sf), sym(spark, sf), "c:@N@hal@S@Outcome")


@query(f"""WITH {BOTH}, e AS (SELECT config_hash, to_usr, from_usr, count(*) AS sites FROM rf WHERE ref_kind IN ('call', 'indirect', 'implicit_construct') AND from_usr IS NOT NULL GROUP BY ALL)
SELECT e.config_hash, to_usr, from_usr, sites, c.name AS caller_name FROM e JOIN sym c ON c.config_hash = e.config_hash AND c.usr = e.from_usr""")
def callers_1hop(spark, sf):
    return R.callers(ref(spark, sf), sym(spark, sf)).select("config_hash", "to_usr", "from_usr", "sites", "caller_name")


@query(f"""WITH {BOTH} SELECT DISTINCT r.config_hash, from_usr, to_usr, ref_kind, c.name AS callee_name FROM rf r JOIN sym c ON c.config_hash = r.config_hash AND c.usr = r.to_usr
WHERE ref_kind IN ('call', 'indirect') AND from_usr IS NOT NULL""")
def callees_1hop(spark, sf):
    return R.callees(ref(spark, sf), sym(spark, sf)).select("config_hash", "from_usr", "to_usr", "ref_kind", "callee_name")


@query(f"""WITH {BOTH}, own AS (SELECT config_hash, usr, row_number() OVER ({ORDER} usr)::INT AS pos FROM sym WHERE name = 'good')
SELECT r.id, r.config_hash, o.pos, row_number() OVER (PARTITION BY r.config_hash, r.to_usr ORDER BY from_file, from_line, from_col, id)::INT AS rn
FROM rf r JOIN own o ON o.config_hash = r.config_hash AND o.usr = r.to_usr""")
def refs_round_robin(spark, sf):
    own = P.numbered(sym(spark, sf).where("name = 'good'"), ["config_hash"], [F.col("usr")], "pos").select("config_hash", "usr", "pos")
    return R.refs_round_robin(ref(spark, sf), own).select("id", "config_hash", "pos", "rn")


@query(f"""WITH {REF} SELECT id, config_hash, to_usr, row_number() OVER w::INT AS rn, count(*) OVER (PARTITION BY config_hash, to_usr) AS total FROM rf
WINDOW w AS (PARTITION BY config_hash, to_usr ORDER BY from_file, from_line, from_col, id) QUALIFY row_number() OVER w <= 5""")
def refs_capped_per_symbol(spark, sf):
    return R.refs_capped(ref(spark, sf), 5).select("id", "config_hash", "to_usr", "rn", "total")


@query(f"""WITH {SYM}, {OVR}, b AS (SELECT config_hash, derived_usr AS usr, 'overrides' AS direction, base_usr AS other_usr FROM ovr
UNION ALL SELECT config_hash, base_usr, 'overridden_by', derived_usr FROM ovr)
SELECT b.config_hash, b.usr, direction, other_usr, s.qualified_name AS other_qualified_name FROM b LEFT JOIN sym s ON s.config_hash = b.config_hash AND s.usr = b.other_usr""")
def override_both_ways(spark, sf):
    return R.overrides_both_ways(overrides(spark, sf), sym(spark, sf)).select("config_hash", "usr", "direction", "other_usr", "other_qualified_name")


@query(f"""WITH {BOTH}, {OVR}, base AS (SELECT config_hash, derived_usr AS usr, min(base_usr) AS base_usr FROM ovr GROUP BY 1, 2),
fam AS (SELECT b.config_hash, b.usr, o.derived_usr AS to_usr FROM base b JOIN ovr o ON o.config_hash = b.config_hash AND o.base_usr = b.base_usr
UNION SELECT config_hash, usr, base_usr FROM base
UNION SELECT a.config_hash, a.usr, b.usr FROM sym a JOIN sym b ON b.config_hash = a.config_hash AND b.parent_usr = a.parent_usr AND b.name = a.name AND b.usr <> a.usr WHERE a.parent_usr <> '' AND a.kind IN ('method', 'destructor')
AND b.kind IN ('method', 'destructor') AND (b.is_virtual = 1 OR b.is_pure_virtual = 1) AND NOT EXISTS (SELECT 1 FROM base x WHERE x.config_hash = a.config_hash AND x.usr = a.usr))
SELECT DISTINCT f.config_hash, f.usr, r.from_usr FROM fam f JOIN rf r ON r.config_hash = f.config_hash AND r.to_usr = f.to_usr
WHERE f.to_usr <> f.usr AND r.from_usr IS NOT NULL AND r.ref_kind IN ('call', 'indirect', 'implicit_construct')""")
def virtual_callers(spark, sf):
    return R.virtual_callers(overrides(spark, sf), ref(spark, sf), sym(spark, sf))


@query(f"""WITH {BOTH} SELECT m.config_hash, m.parent_usr AS class_usr, CASE WHEN contains(c.qualified_name, '::') THEN regexp_extract(c.qualified_name, '^(.*)::', 1) ELSE '(global)' END AS wrapper,
count(*) AS sites, count(DISTINCT m.usr) AS methods FROM rf r JOIN sym m ON m.config_hash = r.config_hash AND m.usr = r.to_usr
JOIN sym c ON c.config_hash = r.config_hash AND c.usr = r.from_usr
WHERE m.kind IN ('method', 'constructor', 'destructor') AND m.parent_usr <> '' AND r.ref_kind IN ('call', 'indirect', 'implicit_construct') GROUP BY ALL""")
def wrapper_rollup(spark, sf):
    return R.wrapper_callers(ref(spark, sf), sym(spark, sf))


@query(f"""WITH {BOTH}, r0 AS (SELECT config_hash, link_name, usr, CASE WHEN is_definition = 1 AND is_weak = 0 THEN 0
WHEN is_weak = 1 AND NOT starts_with(usr, 'ld:') THEN 1 WHEN is_weak = 1 THEN 2 ELSE 3 END AS k FROM sym WHERE link_name <> ''),
b AS (SELECT * FROM r0 QUALIFY k = min(k) OVER (PARTITION BY config_hash, link_name)),
d AS (SELECT config_hash, link_name, min(usr) AS def_usr FROM b GROUP BY config_hash, link_name HAVING count(DISTINCT usr) = 1)
SELECT r.id, coalesce(d.def_usr, r.to_usr) AS to_usr FROM rf r LEFT JOIN sym s ON s.config_hash = r.config_hash AND s.usr = r.to_usr AND s.is_definition = 0 AND s.link_name <> ''
LEFT JOIN d ON d.config_hash = s.config_hash AND d.link_name = s.link_name""")
def declarations_followed(spark, sf):
    s = sym(spark, sf)
    return R.follow_declarations(ref(spark, sf), s, L.link_definition(s)).select("id", "to_usr")


# --- intervals

_ENC = """enc AS (SELECT r.id, min_by(s.usr, {'n': s.end_line - s.line, 'u': s.usr}) AS enclosing_usr FROM rf r JOIN sym s ON s.config_hash = r.config_hash
AND s.file_path = r.from_file AND r.from_line BETWEEN s.line AND s.end_line WHERE s.is_definition = 1 AND s.end_line > 0
AND s.kind IN ('function', 'method', 'constructor', 'destructor') GROUP BY r.id)"""


@query(f"WITH {BOTH}, {_ENC} SELECT id, enclosing_usr FROM enc")
def enclosing_interval(spark, sf):
    return V.enclosing_callable(ref(spark, sf), sym(spark, sf)).select("id", "enclosing_usr")


@query(f"""WITH {BOTH}, {_ENC}, mend AS (SELECT r.* EXCLUDE (from_usr), e.enclosing_usr AS from_usr FROM rf r LEFT JOIN enc e ON e.id = r.id WHERE r.from_usr IS NULL)
SELECT id, from_usr FROM rf WHERE from_usr IS NOT NULL UNION ALL SELECT id, from_usr FROM mend m WHERE NOT EXISTS (SELECT 1 FROM rf k WHERE k.from_usr = m.from_usr
AND k.config_hash = m.config_hash AND k.to_usr = m.to_usr AND k.from_file = m.from_file AND k.from_line = m.from_line AND k.from_col = m.from_col
AND k.ref_kind = m.ref_kind AND coalesce(k.slot_index, -1) = coalesce(m.slot_index, -1))""")
def repair_callers(spark, sf):
    return V.repair_callers(ref(spark, sf), sym(spark, sf)).select("id", "from_usr")


@query(f"""WITH {BOTH}, h AS (SELECT r.id, v.usr FROM rf r JOIN sym v ON v.config_hash = r.config_hash AND v.file_path = r.from_file
AND r.from_line BETWEEN v.line AND greatest(v.line, v.end_line) WHERE v.kind IN ('varglobal', 'enum', 'struct'))
SELECT id, min(usr) AS array_usr FROM h GROUP BY id HAVING count(DISTINCT usr) = 1""")
def unique_owner_range(spark, sf):
    points = ref(spark, sf).select("id", "config_hash", "from_file", "from_line")
    return V.owning_array(points, sym(spark, sf).where("kind in ('varglobal', 'enum', 'struct')")).select("id", "array_usr")


@query(f"""WITH {BOTH}, s AS (SELECT config_hash, file_path, line, min(usr) AS usr FROM sym WHERE is_definition = 1 GROUP BY 1, 2, 3)
SELECT r.id, s.usr AS context_usr FROM rf r ASOF LEFT JOIN s ON s.config_hash = r.config_hash AND s.file_path = r.from_file AND r.from_line >= s.line""")
def innermost_context(spark, sf):
    starts = sym(spark, sf).where("is_definition = 1").groupBy("config_hash", F.col("file_path").alias("from_file"), F.col("line").alias("start")).agg(F.min("usr").alias("context_usr"))
    points = ref(spark, sf).select("id", "config_hash", "from_file", "from_line")
    return V.latest_before(points, starts, ["config_hash", "from_file"], "from_line", "start", "context_usr").select("id", "context_usr")


# --- graphs

_START = "start AS (SELECT config_hash, usr FROM sym WHERE name IN ('board_bringup_all', 'trace_emit'))"


@query(f"""WITH RECURSIVE {BOTH}, {EDGES}, {_START}, w AS (SELECT s.config_hash, s.usr AS target, e.dst AS usr, 1 AS depth FROM start s JOIN edges e ON e.config_hash = s.config_hash AND e.src = s.usr
UNION SELECT w.config_hash, w.target, e.dst, w.depth + 1 FROM w JOIN edges e ON e.config_hash = w.config_hash AND e.src = w.usr WHERE w.depth < 3)
SELECT config_hash, target, usr, min(depth) AS depth FROM w GROUP BY ALL""")
def callees_khop(spark, sf):
    start = sym(spark, sf).where("name in ('board_bringup_all', 'trace_emit')")
    return G.walk(G.call_edges(ref(spark, sf)), start, 3)


@query(f"""WITH RECURSIVE {BOTH}, {EDGES}, {_START}, w AS (SELECT s.config_hash, s.usr AS target, e.src AS usr, 1 AS depth FROM start s JOIN edges e ON e.config_hash = s.config_hash AND e.dst = s.usr
UNION SELECT w.config_hash, w.target, e.src, w.depth + 1 FROM w JOIN edges e ON e.config_hash = w.config_hash AND e.dst = w.usr WHERE w.depth < 3)
SELECT w.config_hash, target, w.usr, s.name, min(depth) AS depth FROM w JOIN sym s ON s.config_hash = w.config_hash AND s.usr = w.usr GROUP BY ALL""")
def callers_khop(spark, sf):
    s = sym(spark, sf)
    found = G.walk(G.call_edges(ref(spark, sf)), s.where("name in ('board_bringup_all', 'trace_emit')"), 3, forward=False)
    return found.join(s.select("config_hash", "usr", "name"), ["config_hash", "usr"]).select("config_hash", "target", "usr", "name", "depth")


#: Bound to make alias pairs: every callable declaration gets a definition _name that calls trace_emit.
_IMPL = """sym2 AS (SELECT config_hash, usr, name, kind, signature, is_definition FROM sym UNION ALL SELECT config_hash, usr || '#', '_' || name, kind, signature, 1 FROM sym
WHERE is_definition = 0 AND kind IN ('function', 'method', 'constructor', 'destructor')),
rf2 AS (SELECT config_hash, from_usr, to_usr, ref_kind FROM rf UNION ALL SELECT config_hash, usr || '#', 'c:@F@trace_emit', 'call' FROM sym WHERE is_definition = 0 AND kind IN ('function', 'method', 'constructor', 'destructor')),
fn AS (SELECT config_hash, usr, name, is_definition, CASE WHEN coalesce(signature, '') = '' THEN 0 ELSE len(string_split(signature, ',')) END AS n FROM sym2 WHERE kind IN ('function', 'method', 'constructor', 'destructor')),
de AS (SELECT * FROM fn f WHERE is_definition = 0 AND EXISTS (SELECT 1 FROM rf2 r WHERE r.config_hash = f.config_hash AND r.to_usr = f.usr) AND NOT EXISTS (SELECT 1 FROM rf2 r WHERE r.config_hash = f.config_hash AND r.from_usr = f.usr)),
ap AS (SELECT de.config_hash, de.usr AS decl_usr, arg_min(e.usr, {'k': CASE WHEN e.name = '__' || de.name THEN 0 ELSE 1 END, 'u': e.usr}) AS def_usr FROM de
JOIN fn e ON e.config_hash = de.config_hash AND e.n = de.n AND e.is_definition = 1 AND e.name IN ('__' || de.name, '_' || de.name) GROUP BY 1, 2),
edges2 AS (SELECT DISTINCT config_hash, from_usr AS src, to_usr AS dst FROM rf2 WHERE ref_kind IN ('call', 'indirect', 'implicit_construct') AND from_usr IS NOT NULL)"""


def _with_definitions(spark, sf):
    s, r = sym(spark, sf), ref(spark, sf)
    declared = s.where((F.col("is_definition") == 0) & F.col("kind").isin(*S.CALLABLE))
    more = declared.withColumns({"usr": F.concat("usr", F.lit("#")), "name": F.concat(F.lit("_"), "name"), "is_definition": F.lit(1)})
    calls = declared.select("config_hash", F.concat("usr", F.lit("#")).alias("from_usr"), F.lit("c:@F@trace_emit").alias("to_usr"), F.lit("call").alias("ref_kind"))
    return s.unionByName(more), r.unionByName(calls, allowMissingColumns=True)


@query(f"""WITH RECURSIVE {BOTH}, {_IMPL}, e AS (SELECT * FROM edges2 UNION SELECT x.config_hash, x.src, ap.def_usr FROM edges2 x JOIN ap ON ap.config_hash = x.config_hash AND ap.decl_usr = x.dst),
w AS (SELECT e.config_hash, e.dst AS target, e.src AS usr, 1 AS depth FROM e WHERE e.dst = 'c:@F@trace_emit'
UNION SELECT w.config_hash, w.target, e.src, w.depth + 1 FROM w JOIN e ON e.config_hash = w.config_hash AND e.dst = w.usr WHERE w.depth < 4)
SELECT w.config_hash, target, w.usr, s.name, min(depth) AS depth FROM w JOIN sym2 s ON s.config_hash = w.config_hash AND s.usr = w.usr GROUP BY ALL""")
def callers_with_aliases(spark, sf):
    s, r = _with_definitions(spark, sf)
    edges = G.alias_edges(G.call_edges(r), G.alias_pairs(s, r), forward=False)
    start = s.select("config_hash").distinct().withColumn("usr", F.lit("c:@F@trace_emit"))
    return G.walk(edges, start, 4, forward=False).join(s.select("config_hash", "usr", "name"), ["config_hash", "usr"]).select("config_hash", "target", "usr", "name", "depth")


@query(f"""WITH RECURSIVE {BOTH}, {_IMPL}, e AS (SELECT * FROM edges2 UNION SELECT x.config_hash, ap.decl_usr, x.dst FROM edges2 x JOIN ap ON ap.config_hash = x.config_hash AND ap.def_usr = x.src),
start AS (SELECT config_hash, usr FROM sym2 WHERE name = 'board_bringup_all'), w AS (SELECT s.config_hash, s.usr AS target, e.dst AS usr, 1 AS depth FROM start s JOIN e ON e.config_hash = s.config_hash AND e.src = s.usr
UNION SELECT w.config_hash, w.target, e.dst, w.depth + 1 FROM w JOIN e ON e.config_hash = w.config_hash AND e.src = w.usr WHERE w.depth < 4), n AS (SELECT w.config_hash, target, w.usr, s.name, min(depth) AS depth FROM w JOIN sym2 s ON s.config_hash = w.config_hash AND s.usr = w.usr GROUP BY ALL)
SELECT *, count(*) OVER () AS total FROM n ORDER BY depth, name, usr, target, config_hash LIMIT 50 OFFSET 10""")
def callees_with_aliases_page(spark, sf):
    s, r = _with_definitions(spark, sf)
    edges = G.alias_edges(G.call_edges(r), G.alias_pairs(s, r), forward=True)
    found = G.walk(edges, s.where("name = 'board_bringup_all'"), 4).join(s.select("config_hash", "usr", "name"), ["config_hash", "usr"])
    rows, notice = P.page_with_total(found, [F.col(c) for c in ("depth", "name", "usr", "target", "config_hash")], 50, 10)
    return rows.select("config_hash", "target", "usr", "name", "depth", F.lit(notice.total).cast("long").alias("total"))


@query(f"""WITH RECURSIVE {BOTH}, {EDGES}, g AS (SELECT config_hash, usr FROM sym WHERE name = 'sched_lock_enter'), st AS (SELECT config_hash, usr FROM sym WHERE name = 'board_bringup_all'),
lv AS (SELECT config_hash, usr AS src, usr, 0 AS depth FROM st UNION SELECT lv.config_hash, lv.src, e.dst, lv.depth + 1 FROM lv JOIN edges e ON e.config_hash = lv.config_hash AND e.src = lv.usr WHERE lv.depth < 4),
near AS (SELECT config_hash, src, usr, min(depth) AS depth FROM lv GROUP BY 1, 2, 3),
p AS (SELECT config_hash, usr AS src, usr, [usr] AS path FROM st UNION ALL SELECT p.config_hash, p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN edges e ON e.config_hash = p.config_hash AND e.src = p.usr
JOIN near n ON n.config_hash = p.config_hash AND n.src = p.src AND n.usr = e.dst AND n.depth = len(p.path) JOIN near m ON m.config_hash = p.config_hash AND m.src = p.src AND m.usr = p.usr AND m.depth = len(p.path) - 1 WHERE len(p.path) <= 4)
SELECT p.config_hash, p.src, p.usr AS dst, (len(path) - 1)::INT AS depth, path, row_number() OVER (PARTITION BY p.config_hash, p.src, p.usr ORDER BY path)::INT AS rn
FROM p JOIN g ON g.config_hash = p.config_hash AND g.usr = p.usr WHERE len(path) > 1 QUALIFY rn <= 5""")
def call_paths_five(spark, sf):
    s = sym(spark, sf)
    paths, _ = G.call_paths(G.call_edges(ref(spark, sf)), s.where("name = 'board_bringup_all'"), s.where("name = 'sched_lock_enter'"), 4, max_nodes=None)
    return paths


@query(f"""WITH RECURSIVE {BOTH}, {EDGES}, g AS (SELECT config_hash, usr FROM sym WHERE name IN ('sched_lock_enter', 'cpu_relax')), st AS (SELECT config_hash, usr FROM sym WHERE name = 'trace_emit' OR name = 'board_bringup_all'),
lv AS (SELECT config_hash, usr AS src, usr, 0 AS depth FROM st UNION SELECT lv.config_hash, lv.src, e.dst, lv.depth + 1 FROM lv JOIN edges e ON e.config_hash = lv.config_hash AND e.src = lv.usr WHERE lv.depth < 3)
SELECT s.config_hash, s.usr AS src, g.usr AS dst, CASE WHEN EXISTS (SELECT 1 FROM lv WHERE lv.config_hash = s.config_hash AND lv.src = s.usr AND lv.usr = g.usr AND lv.depth > 0 AND g.usr <> s.usr) THEN 'found' ELSE 'not_found' END AS outcome
FROM st s JOIN g ON g.config_hash = s.config_hash""")
def call_path_outcomes(spark, sf):
    s = sym(spark, sf)
    return G.call_paths(G.call_edges(ref(spark, sf)), s.where("name in ('trace_emit', 'board_bringup_all')"), s.where("name in ('sched_lock_enter', 'cpu_relax')"), 3, max_nodes=None)[1]


@query(f"""WITH RECURSIVE {BOTH}, {EDGES}, w AS (SELECT s.config_hash, s.usr AS src, s.usr, 0 AS depth FROM sym s WHERE s.name = 'board_bringup_all'
UNION SELECT w.config_hash, w.src, e.dst, w.depth + 1 FROM w JOIN edges e ON e.config_hash = w.config_hash AND e.src = w.usr WHERE w.depth < 4)
SELECT w.config_hash, w.src, w.usr AS dst, min(depth) AS depth, min(depth) + 1 AS nodes FROM w JOIN sym g ON g.config_hash = w.config_hash AND g.usr = w.usr AND g.name = 'sched_lock_enter'
WHERE depth > 0 GROUP BY ALL""")
def call_path(spark, sf):
    s = sym(spark, sf)
    found = G.shortest_paths(G.call_edges(ref(spark, sf)), s.where("name = 'board_bringup_all'"), s.where("name = 'sched_lock_enter'"), 4)
    return found.select("config_hash", "src", "dst", "depth", F.size("path").alias("nodes"))


@query(f"""WITH {BOTH}, f AS (SELECT * FROM sym WHERE is_definition = 1 AND kind IN ('function', 'method', 'constructor', 'destructor')),
k AS (SELECT config_hash, to_usr AS usr, bool_or(ref_kind = 'call') AS called, bool_or(ref_kind = 'indirect') AS indirect FROM rf GROUP BY 1, 2),
st AS (SELECT config_hash, usr, array_to_string(list_sort(list(site))[1:3], ', ') AS sites FROM (SELECT DISTINCT config_hash, to_usr AS usr, from_file || ':' || from_line AS site FROM rf WHERE ref_kind = 'indirect') GROUP BY 1, 2)
SELECT f.config_hash, f.usr, CASE WHEN k.usr IS NULL THEN 'dead' ELSE 'possibly_dead' END AS category, CASE WHEN k.usr IS NULL THEN NULL ELSE st.sites END AS sites
FROM f LEFT JOIN k ON k.config_hash = f.config_hash AND k.usr = f.usr LEFT JOIN st ON st.config_hash = f.config_hash AND st.usr = f.usr
WHERE k.usr IS NULL OR (k.indirect AND NOT k.called)""")
def dead_code(spark, sf):
    return G.dead_code(sym(spark, sf), ref(spark, sf)).select("config_hash", "usr", "category", "sites")


_HOT = """hot AS (SELECT s.config_hash, s.usr, s.name, count(*) AS caller_count FROM rf r JOIN sym s ON s.config_hash = r.config_hash AND s.usr = r.to_usr
WHERE s.is_definition = 1 AND r.ref_kind IN ('call', 'indirect', 'implicit_construct') GROUP BY ALL)"""


@query(f"WITH {BOTH}, {_HOT} SELECT config_hash, usr, name, caller_count FROM hot ORDER BY caller_count DESC, config_hash, usr LIMIT 50")
def hotspots(spark, sf):
    return P.page(G.hotspots(sym(spark, sf), ref(spark, sf)), [F.desc("caller_count"), F.col("config_hash"), F.col("usr")], 50).select("config_hash", "usr", "name", "caller_count")


@query(f"WITH {BOTH}, {_HOT} SELECT config_hash, count(*) AS hotspots FROM hot GROUP BY 1")
def hotspot_count(spark, sf):
    return G.hotspots(sym(spark, sf), ref(spark, sf)).groupBy("config_hash").agg(F.count(F.lit(1)).alias("hotspots"))


@query(f"WITH {BOTH}, {_HOT} SELECT config_hash, usr, name, caller_count FROM hot")
def hotspot_table(spark, sf):
    """The table of hotspots, written as a version of its own and read back."""
    path = scratch_path(spark, "hotspots")
    replace_table(G.hotspots(sym(spark, sf), ref(spark, sf)), path, ["config_hash"])
    return read_table(spark, path).select("config_hash", "usr", "name", "caller_count")


def _rank_sql(rounds: int) -> str:
    out = f"""WITH {BOTH}, fn AS (SELECT config_hash, usr FROM sym WHERE kind IN ('function', 'method', 'constructor', 'destructor', 'lambda') AND usr <> ''),
e AS (SELECT DISTINCT r.config_hash, r.from_usr AS src, r.to_usr AS dst FROM rf r SEMI JOIN fn a ON a.config_hash = r.config_hash AND a.usr = r.from_usr
WHERE r.ref_kind = 'call' AND EXISTS (SELECT 1 FROM fn b WHERE b.config_hash = r.config_hash AND b.usr = r.to_usr)),
d AS (SELECT config_hash, src, count(*) AS deg FROM e GROUP BY 1, 2),
n0 AS (SELECT config_hash, src AS usr FROM e UNION SELECT config_hash, dst FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY config_hash) AS n FROM n0),
s0 AS (SELECT config_hash, usr, 1.0::DOUBLE / n AS score FROM n)"""
    for i in range(1, rounds + 1):
        out += f""",
s{i} AS (SELECT n.config_hash, n.usr, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(g.got, 0) AS score FROM n LEFT JOIN (SELECT e.config_hash, e.dst, sum(s.score / d.deg) AS got FROM e
JOIN d ON d.config_hash = e.config_hash AND d.src = e.src JOIN s{i - 1} s ON s.config_hash = e.config_hash AND s.usr = e.src GROUP BY 1, 2) g ON g.config_hash = n.config_hash AND g.dst = n.usr)"""
    return out + f" SELECT config_hash, usr, round(score / max(score) OVER (PARTITION BY config_hash), 6) AS pagerank FROM s{rounds}"


@query(_rank_sql(5))
def pagerank_k(spark, sf):
    return G.pagerank(sym(spark, sf), ref(spark, sf), rounds=5, tolerance=0).withColumn("pagerank", F.round("pagerank", 6))


@query(f"""WITH RECURSIVE {SYM}, {INH}, w AS (SELECT config_hash, derived_usr AS start_usr, base_usr AS usr, 1 AS depth FROM inh
UNION SELECT w.config_hash, w.start_usr, i.base_usr, w.depth + 1 FROM w JOIN inh i ON i.config_hash = w.config_hash AND i.derived_usr = w.usr WHERE w.depth < 10),
n AS (SELECT config_hash, start_usr, usr, min(depth) AS depth FROM w WHERE usr <> start_usr GROUP BY ALL), o AS (SELECT * FROM n UNION ALL SELECT DISTINCT config_hash, start_usr, start_usr, 0 FROM w)
SELECT n.config_hash, n.start_usr, n.usr, n.depth, arg_min(i.access, (i.derived_usr, i.access, i.is_virtual)) AS access, arg_min(i.is_virtual, (i.derived_usr, i.access, i.is_virtual)) AS is_virtual
FROM n JOIN inh i ON i.config_hash = n.config_hash AND i.base_usr = n.usr JOIN o ON o.config_hash = n.config_hash AND o.start_usr = n.start_usr AND o.usr = i.derived_usr AND o.depth = n.depth - 1 GROUP BY 1, 2, 3, 4""")
def inheritance_chain(spark, sf):
    return G.inheritance_closure(inheritance(spark, sf)).select("config_hash", "start_usr", "usr", "depth", "access", "is_virtual")


@query(f"""WITH {SYM}, {INH}, own AS (SELECT config_hash, usr FROM sym WHERE kind IN ('class', 'struct', 'union'))
SELECT o.config_hash, o.usr, 'base' AS direction, i.base_usr AS other_usr, i.access FROM own o JOIN inh i ON i.config_hash = o.config_hash AND i.derived_usr = o.usr
UNION ALL SELECT o.config_hash, o.usr, 'derived', i.derived_usr, i.access FROM own o JOIN inh i ON i.config_hash = o.config_hash AND i.base_usr = o.usr""")
def direct_relatives(spark, sf):
    return R.direct_relatives(inheritance(spark, sf), sym(spark, sf).where("kind in ('class', 'struct', 'union')").select("config_hash", "usr")).select("config_hash", "usr", "direction", "other_usr", "access")


@query(f"""WITH RECURSIVE {SYM}, {OVR}, w AS (SELECT config_hash, derived_usr, base_usr FROM ovr
UNION SELECT w.config_hash, w.derived_usr, o.base_usr FROM w JOIN ovr o ON o.config_hash = w.config_hash AND o.derived_usr = w.base_usr)
SELECT config_hash, derived_usr, base_usr FROM w""")
def overrides_closed(spark, sf):
    return G.close_overrides(overrides(spark, sf))


@query(f"""WITH {BOTH}, fn AS (SELECT config_hash, usr, name, is_definition, CASE WHEN coalesce(signature, '') = '' THEN 0 ELSE len(string_split(signature, ',')) END AS n FROM sym WHERE kind IN ('function', 'method', 'constructor', 'destructor')),
d AS (SELECT * FROM fn f WHERE is_definition = 0 AND EXISTS (SELECT 1 FROM rf r WHERE r.config_hash = f.config_hash AND r.to_usr = f.usr) AND NOT EXISTS (SELECT 1 FROM rf r WHERE r.config_hash = f.config_hash AND r.from_usr = f.usr)),
p AS (SELECT d.config_hash, d.usr AS decl_usr, e.usr AS def_usr, CASE WHEN e.name = '__' || d.name THEN 0 ELSE 1 END AS k FROM d JOIN fn e ON e.config_hash = d.config_hash AND e.n = d.n AND e.is_definition = 1 AND e.name IN ('__' || d.name, '_' || d.name))
SELECT config_hash, decl_usr, arg_min(def_usr, {{'k': k, 'u': def_usr}}) AS def_usr FROM p GROUP BY 1, 2""")
def alias_pairs(spark, sf):
    return G.alias_pairs(sym(spark, sf), ref(spark, sf))


@query(f"WITH {BOTH}, {_IMPL} SELECT config_hash, decl_usr, def_usr FROM ap")
def alias_pairs_bound(spark, sf):
    return G.alias_pairs(*_with_definitions(spark, sf))


@query(f"""WITH RECURSIVE {BOTH}, {EDGES}, {_HOT}, u AS (SELECT h.config_hash, h.usr FROM hot h JOIN sym s ON s.config_hash = h.config_hash AND s.usr = h.usr WHERE contains(lower(s.signature), 'struct ctx')
QUALIFY row_number() OVER (PARTITION BY h.config_hash ORDER BY h.caller_count DESC, h.usr) <= 15), w AS (SELECT config_hash, usr AS src, usr, 0 AS depth FROM u
UNION SELECT w.config_hash, w.src, e.dst, w.depth + 1 FROM w JOIN edges e ON e.config_hash = w.config_hash AND e.src = w.usr WHERE w.depth < 4)
SELECT w.config_hash, w.src, w.usr AS dst, min(depth) AS depth FROM w JOIN sym g ON g.config_hash = w.config_hash AND g.usr = w.usr AND g.name = 'sched_lock_enter' WHERE w.usr <> w.src AND depth > 0 GROUP BY ALL""")
def data_flow(spark, sf):
    return G.data_flow(sym(spark, sf), ref(spark, sf), "struct ctx", "sched_lock_enter", 4).select("config_hash", "src", "dst", "depth")


@query(f"""WITH {BOTH}, e AS (SELECT DISTINCT config_hash, from_usr AS src, to_usr AS dst FROM rf WHERE ref_kind = 'call' AND from_usr IS NOT NULL),
own AS (SELECT config_hash, usr FROM sym WHERE name = 'shell_command_loop'),
near AS (SELECT e.config_hash, e.src AS usr FROM e JOIN own o ON o.config_hash = e.config_hash AND o.usr = e.dst UNION SELECT e.config_hash, e.dst FROM e JOIN own o ON o.config_hash = e.config_hash AND o.usr = e.src),
new AS (SELECT s.config_hash, s.usr, s.kind, row_number() OVER (PARTITION BY s.config_hash, s.kind ORDER BY s.usr) AS turn FROM near n JOIN sym s ON s.config_hash = n.config_hash AND s.usr = n.usr
WHERE s.is_project = 1 AND s.is_definition = 1 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.config_hash = n.config_hash AND o.usr = n.usr))
SELECT config_hash, usr FROM new QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY turn, kind, usr) <= 5""")
def expand_context(spark, sf):
    s = sym(spark, sf)
    return G.expand_context(s.where("name = 'shell_command_loop'"), s, ref(spark, sf)).select("config_hash", "usr")


# --- pages, ranges, scalars

@query(f"WITH {SYM} SELECT config_hash, usr, name, count(*) OVER () AS total FROM sym ORDER BY name, config_hash, usr LIMIT 25 OFFSET 50")
def page_with_total(spark, sf):
    rows, notice = P.page_with_total(sym(spark, sf), [F.col("name"), F.col("config_hash"), F.col("usr")], 25, 50)
    return rows.select("config_hash", "usr", "name", F.lit(notice.total).cast("long").alias("total"))


@query("""WITH d AS (SELECT DISTINCT config_hash, slot_index AS s FROM refs WHERE ref_kind = 'vector' AND slot_index IS NOT NULL),
g AS (SELECT *, s - row_number() OVER (PARTITION BY config_hash ORDER BY s) AS k FROM d), r AS (SELECT config_hash, min(s) AS a, max(s) AS b FROM g GROUP BY config_hash, k)
SELECT config_hash, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def number_ranges(spark, sf):
    return P.number_ranges(load(spark, sf, "refs").where("ref_kind = 'vector' and slot_index is not null"), ["config_hash"], "slot_index")


@query("""WITH d AS (SELECT DISTINCT config_hash, slot_index AS s FROM refs WHERE ref_kind = 'vector' AND slot_index IS NOT NULL), n AS (SELECT DISTINCT config_hash, unnest(range(0, 64))::INT AS s FROM d),
m AS (SELECT * FROM n EXCEPT SELECT * FROM d), g AS (SELECT *, s - row_number() OVER (PARTITION BY config_hash ORDER BY s) AS k FROM m), r AS (SELECT config_hash, min(s) AS a, max(s) AS b FROM g GROUP BY config_hash, k)
SELECT config_hash, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def gap_ranges(spark, sf):
    have = load(spark, sf, "refs").where("ref_kind = 'vector' and slot_index is not null").select("config_hash", "slot_index").distinct()
    due = have.select("config_hash").distinct().withColumn("slot_index", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return P.number_ranges(due.join(have, ["config_hash", "slot_index"], "left_anti"), ["config_hash"], "slot_index")


@query("""WITH d AS (SELECT DISTINCT config_hash, from_file, slot_index AS s FROM refs WHERE ref_kind = 'vector' AND slot_index IS NOT NULL), t AS (SELECT config_hash, from_file, max(s) + 8 AS n, count(*) AS present FROM d GROUP BY 1, 2),
m AS (SELECT config_hash, from_file, unnest(range(0, n))::INT AS s FROM t EXCEPT SELECT * FROM d), g AS (SELECT *, s - row_number() OVER (PARTITION BY config_hash, from_file ORDER BY s) AS k FROM m),
r AS (SELECT config_hash, from_file, min(s) AS a, max(s) AS b FROM g GROUP BY config_hash, from_file, k), x AS (SELECT config_hash, from_file, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1, 2)
SELECT t.config_hash, t.from_file, t.n::INT AS declared, t.present, x.ranges FROM t LEFT JOIN x ON x.config_hash = t.config_hash AND x.from_file = t.from_file""")
def table_gaps(spark, sf):
    """Bound: a file's vector references are a table, declared with eight places more than its last."""
    have = load(spark, sf, "refs").where("ref_kind = 'vector' and slot_index is not null").select("config_hash", "from_file", "slot_index")
    length = F.max("slot_index") + 8
    tables = have.groupBy("config_hash", "from_file").agg(F.concat(F.lit("handler vectors["), length.cast("string"), F.lit("]")).alias("signature"))
    return P.table_coverage(tables, have, ["config_hash", "from_file"], "slot_index")


@query("""SELECT id, list_filter(['direct', 'asm', 'sdk', 'instantiation', 'slot', 'type_only'], lambda x, i: (origins & [1, 4, 8, 16, 32, 64][i]) <> 0) AS names FROM refs""")
def origin_names(spark, sf):
    return load(spark, sf, "refs").select("id", S.origin_names(F.col("origins")).alias("names"))


@query("""SELECT id, CASE WHEN coalesce(signature, '') = '' THEN 0 ELSE len(string_split(signature, ',')) END::INT AS n_params,
CASE WHEN contains(qualified_name, '::') THEN regexp_extract(qualified_name, '^(.*)::', 1) ELSE '(global)' END AS scope, regexp_extract(qualified_name, '([^:]*)$', 1) AS tail,
sha256(trim(coalesce(source, '')) || chr(31) || coalesce(qualified_name, '') || chr(31) || coalesce(signature, '') || chr(31) || trim(coalesce(docstring, ''))) AS body_hash FROM symbols""")
def scalar_functions(spark, sf):
    c = F.col
    return load(spark, sf, "symbols").select(
        "id", S.parameter_count(c("signature")).alias("n_params"), S.scope_name(c("qualified_name")).alias("scope"), S.tail_name(c("qualified_name")).alias("tail"),
        S.body_hash(c("source"), c("qualified_name"), c("signature"), c("docstring")).alias("body_hash"))


def _split_sql(c: str) -> str:
    out = f"regexp_replace({c}, '\\((?:unnamed|anonymous)[^)]*\\)', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{S.CASE_CUTS[0][0]}', '\\1 \\2', 'g'), '{S.CASE_CUTS[1][0]}', '\\1 \\2', 'g')"
    return f"string_split(trim(lower(regexp_replace({out}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"


@query(f"""SELECT id, list_sort(list_distinct(list_filter(list_concat({_split_sql('name')}, {_split_sql('qualified_name')}), lambda w: length(w) > 1 AND w NOT IN ('at', 'unnamed', 'anonymous')))) AS tokens FROM symbols""")
def name_tokens(spark, sf):
    return load(spark, sf, "symbols").select("id", F.array_sort(S.name_tokens(F.col("name"), F.col("qualified_name"))).alias("tokens"))


# --- aggregates

@query(f"""WITH {SYM} SELECT config_hash, kind, count(*) AS symbols, sum(is_definition)::BIGINT AS definitions, sum(CASE WHEN docstring <> '' THEN 1 ELSE 0 END)::BIGINT AS documented FROM sym GROUP BY 1, 2""")
def build_stats(spark, sf):
    return A.build_stats(sym(spark, sf))


@query(f"""WITH {BOTH} SELECT b.config_hash, (SELECT count(*) FROM sym s WHERE s.config_hash = b.config_hash) AS symbols, (SELECT count(*) FROM sym s WHERE s.config_hash = b.config_hash AND is_definition = 1) AS definitions,
(SELECT count(DISTINCT id) FROM files f WHERE f.config_hash = b.config_hash) AS files, (SELECT count(*) FROM rf r WHERE r.config_hash = b.config_hash) AS refs, (SELECT count(*) FROM sym s WHERE s.config_hash = b.config_hash AND kind = 'enum_constant') AS macros FROM build_configs b""")
def build_totals(spark, sf):
    s = sym(spark, sf)
    return A.build_totals(load(spark, sf, "build_configs"), s, load(spark, sf, "files"), ref(spark, sf), s.where("kind = 'enum_constant'"))


@query(f"""WITH {SYM}, a AS (SELECT DISTINCT symbol_id AS id FROM symbols_fts WHERE summary <> '')
SELECT s.config_hash, s.is_project, count(*) AS total, count(a.id) AS analysed FROM sym s LEFT JOIN a ON a.id = s.id WHERE s.is_definition = 1 AND NOT contains(s.name, '(unnamed') GROUP BY 1, 2""")
def coverage_conditional(spark, sf):
    return A.coverage(sym(spark, sf), load(spark, sf, "symbols_fts").where("summary <> ''").select(F.col("symbol_id").alias("id")).distinct())


@query("SELECT model, count(*) AS n FROM embedding_stash GROUP BY 1")
def model_histogram(spark, sf):
    return A.histogram(load(spark, sf, "embedding_stash"), "model")


@query(f"""WITH {SYM} SELECT config_hash, id FROM sym WHERE is_definition = 1 AND id NOT IN (SELECT donor_id FROM embedding_stash WHERE chunk_index = 0 AND embedding IS NOT NULL)""")
def missing_embeddings(spark, sf):
    have = load(spark, sf, "embedding_stash").where("chunk_index = 0 and embedding is not null").select(F.col("donor_id").alias("id"))
    return A.missing(sym(spark, sf).where("is_definition = 1"), have, "id").select("config_hash", "id")


@query("""SELECT p.project_id, b.config_hash, coalesce(s.n, 0) AS symbols, coalesce(f.n, 0) AS files, coalesce(r.n, 0) AS refs FROM projects p LEFT JOIN build_configs b ON b.project_id = p.project_id
LEFT JOIN (SELECT config_hash, count(DISTINCT usr) AS n FROM symbols GROUP BY 1) s ON s.config_hash = b.config_hash
LEFT JOIN (SELECT config_hash, count(DISTINCT id) AS n FROM files GROUP BY 1) f ON f.config_hash = b.config_hash
LEFT JOIN (SELECT config_hash, count(DISTINCT id) AS n FROM refs GROUP BY 1) r ON r.config_hash = b.config_hash""")
def preagg_counts(spark, sf):
    return A.project_counts(*[load(spark, sf, t) for t in ("projects", "build_configs", "symbols", "files", "refs")])


@query(f"WITH {REF} SELECT config_hash, to_usr, bit_or(origins) AS origins FROM rf GROUP BY 1, 2")
def origins_bit_or(spark, sf):
    return ref(spark, sf).groupBy("config_hash", "to_usr").agg(F.bit_or("origins").alias("origins"))


@query("""WITH s AS (SELECT name, kind, signature, config_hash, count(*) AS units FROM symbols WHERE signature IS NOT NULL GROUP BY ALL),
k AS (SELECT name, kind, signature, sum(units)::BIGINT AS units FROM s GROUP BY ALL)
SELECT name, kind, count(*) AS states, CASE WHEN count(*) = 1 THEN min(signature) END AS agreed, max(units) AS most FROM k GROUP BY 1, 2""")
def macro_consensus(spark, sf):
    return A.consensus(load(spark, sf, "symbols").where("signature is not null"), ["name", "kind"], "signature")


@query(f"""WITH {SYM} SELECT name, count(DISTINCT file_path) AS files, min(file_path) AS place FROM sym WHERE kind IN ('class', 'struct', 'union', 'enum', 'typedef') GROUP BY 1
HAVING count(DISTINCT file_path) > 1 AND NOT bool_or(file_path IN (SELECT path FROM files WHERE language = 'cpp' AND is_project = 1 AND regexp_matches(path, '\\.(cpp|cc|cxx)$')))""")
def odr_groups(spark, sf):
    """The merge key of a type is its name; main files are the C++ units of the project."""
    mains = load(spark, sf, "files").where("language = 'cpp' and is_project = 1").where(F.col("path").rlike(r"\.(cpp|cc|cxx)$")).select("path")
    return A.odr_groups(sym(spark, sf).where("kind in ('class', 'struct', 'union', 'enum', 'typedef')"), ["name"], mains)


# --- merges and maintenance

@query(f"WITH {SYM} SELECT config_hash, usr, id, is_definition, is_weak FROM sym")
def symbol_merge(spark, sf):
    return sym(spark, sf).select("config_hash", "usr", "id", "is_definition", "is_weak")


@query(f"WITH {REF} SELECT id, config_hash, to_usr, from_usr, ref_kind, slot_index, origins FROM rf")
def ref_merge(spark, sf):
    return ref(spark, sf).select("id", "config_hash", "to_usr", "from_usr", "ref_kind", "slot_index", "origins")


@query(f"""WITH {REF}, p AS (SELECT DISTINCT r.id FROM rf r JOIN files f ON f.config_hash = r.config_hash AND f.path = r.from_file)
SELECT r.id, CASE WHEN p.id IS NULL THEN origins & ~16 ELSE origins END AS origins FROM rf r LEFT JOIN p ON p.id = r.id WHERE CASE WHEN p.id IS NULL THEN origins & ~16 ELSE origins END <> 0""")
def producers_released(spark, sf):
    r = ref(spark, sf)
    listed = load(spark, sf, "files").select("config_hash", F.col("path").alias("from_file")).distinct()
    producers = r.join(listed, ["config_hash", "from_file"], "left_semi").select(F.col("id").alias("ref_id"))
    return M.release_producers(r, producers).select("id", "origins")


_CACHE = "a AS (SELECT content_hash, min(stash_id) AS stash_id FROM embedding_stash WHERE chunk_index = 0 GROUP BY 1), b AS (SELECT content_hash, min(stash_id) AS stash_id FROM embedding_stash WHERE chunk_index > 0 OR is_project = 1 GROUP BY 1)"


def _cache(spark, sf):
    """An old cache, of the first chunks, and what is put into it: later chunks and project code."""
    e = load(spark, sf, "embedding_stash").select("content_hash", "stash_id", "chunk_index", "is_project")
    pick = lambda df: df.groupBy("content_hash").agg(F.min("stash_id").alias("stash_id"))
    return pick(e.where("chunk_index = 0")), pick(e.where("chunk_index > 0 or is_project = 1"))


@query(f"WITH {_CACHE} SELECT coalesce(a.content_hash, b.content_hash) AS content_hash, coalesce(a.stash_id, b.stash_id) AS stash_id FROM a FULL JOIN b ON a.content_hash IS NOT DISTINCT FROM b.content_hash")
def cache_first_write(spark, sf):
    return M.cache_put(*_cache(spark, sf), "content_hash")


@query(f"WITH {_CACHE} SELECT coalesce(a.content_hash, b.content_hash) AS content_hash, coalesce(b.stash_id, a.stash_id) AS stash_id FROM a FULL JOIN b ON a.content_hash IS NOT DISTINCT FROM b.content_hash")
def cache_overwrite(spark, sf):
    return M.cache_put(*_cache(spark, sf), "content_hash", overwrite=True)


@query(f"WITH {_CACHE} SELECT DISTINCT e.content_hash, a.stash_id FROM embedding_stash e LEFT JOIN a ON a.content_hash = e.content_hash")
def cache_lookup(spark, sf):
    return M.cache_get(load(spark, sf, "embedding_stash").select("content_hash").distinct(), _cache(spark, sf)[0], "content_hash")


@query("""SELECT config_hash, project_id FROM build_configs b WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.config_hash = b.config_hash AND r.state = 'ok')
QUALIFY row_number() OVER (PARTITION BY project_id, variant, image ORDER BY created_at DESC, config_hash DESC) = 1""")
def latest_build_per_pair(spark, sf):
    return M.latest_builds(load(spark, sf, "build_configs"), load(spark, sf, "index_runs")).select("config_hash", "project_id")


@query("""SELECT project_id, config_hash, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, config_hash DESC)::INT AS rn FROM build_configs b
WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.config_hash = b.config_hash AND r.state = 'ok') AND variant = (SELECT min(variant) FROM build_configs)""")
def builds_of_scope(spark, sf):
    b = load(spark, sf, "build_configs")
    return M.builds_of_scope(b, load(spark, sf, "index_runs"), variant=b.agg(F.min("variant")).first()[0]).select("project_id", "config_hash", "rn")


@query("""WITH ok AS (SELECT config_hash, max(run_no) AS run_no, arg_max(started_at, run_no) AS since FROM index_runs WHERE state = 'ok' GROUP BY 1),
fr AS (SELECT f.config_hash, f.path AS file_path, max(since) AS since FROM files f JOIN ok ON ok.config_hash = f.config_hash AND ok.run_no = f.run_no GROUP BY 1, 2),
r AS (SELECT s.config_hash, s.usr, s.id, row_number() OVER (PARTITION BY s.config_hash, s.usr ORDER BY coalesce(s.seen_at < fr.since, false), coalesce(is_definition, 0) DESC, coalesce(is_weak, 0), coalesce(is_tentative, 0), s.seen_at, s.id) AS k
FROM symbols s LEFT JOIN fr ON fr.config_hash = s.config_hash AND fr.file_path = s.file_path WHERE removed_at IS NULL AND s.usr IS NOT NULL AND s.config_hash IS NOT NULL) SELECT config_hash, usr, id FROM r WHERE k = 1""")
def symbol_merge_stale(spark, sf):
    """The merge after the files of each build's newest good run were read anew."""
    newest = load(spark, sf, "index_runs").where("state = 'ok'").groupBy("config_hash").agg(F.max("run_no").alias("run_no"), F.max_by("started_at", "run_no").alias("since"))
    fresh = load(spark, sf, "files").join(newest, ["config_hash", "run_no"]).select("config_hash", F.col("path").alias("file_path"), "since")
    return M.merge_symbols(load(spark, sf, "symbols"), fresh).select("config_hash", "usr", "id")


_RUNS = """ok AS (SELECT config_hash, run_no, lag(run_no) OVER (PARTITION BY config_hash ORDER BY run_no) AS last_run FROM (SELECT DISTINCT config_hash, run_no FROM index_runs WHERE state = 'ok')),
now_ AS (SELECT f.* FROM files f JOIN ok ON ok.config_hash = f.config_hash AND ok.run_no = f.run_no), was_ AS (SELECT f.* REPLACE (ok.run_no AS run_no) FROM files f JOIN ok ON ok.config_hash = f.config_hash AND ok.last_run = f.run_no)"""


@query(f"""WITH {_RUNS}, a AS (SELECT config_hash, run_no, path, list_sort(list(DISTINCT {{'s': source_hash, 'f': flags_hash}})) AS l, bool_or(coalesce(source_hash, '') = '' OR coalesce(flags_hash, '') = '') AS o FROM now_ GROUP BY 1, 2, 3),
b AS (SELECT config_hash, run_no, path, list_sort(list(DISTINCT {{'s': source_hash, 'f': flags_hash}})) AS l, bool_or(coalesce(source_hash, '') = '' OR coalesce(flags_hash, '') = '') AS o FROM was_ GROUP BY 1, 2, 3)
SELECT coalesce(a.config_hash, b.config_hash) AS config_hash, coalesce(a.run_no, b.run_no) AS run_no, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone'
WHEN a.l = b.l AND NOT a.o AND NOT b.o THEN 'unchanged' ELSE 'changed' END AS decision FROM a FULL JOIN b ON a.config_hash = b.config_hash AND a.run_no = b.run_no AND a.path = b.path""")
def changed_units(spark, sf):
    now, was = M.against_last(load(spark, sf, "files"), load(spark, sf, "index_runs"))
    return M.decide_units(now, was, ["config_hash", "run_no", "path"], ["source_hash", "flags_hash"])


@query(f"""WITH {SYM} SELECT id, config_hash, path FROM (SELECT DISTINCT id, config_hash, path, nullif(language, 'c') AS content_hash FROM files) f WHERE coalesce(content_hash, '') = ''
AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.config_hash = f.config_hash AND s.file_id = f.id AND s.kind IN ('enum', 'enum_constant'))""")
def orphan_files(spark, sf):
    """Bound so that there are some: the content counts as empty for C files, symbols are the enums, macros their constants."""
    f = load(spark, sf, "files").select("id", "config_hash", "path", F.when(F.col("language") != "c", F.col("language")).alias("content_hash")).distinct()
    s = sym(spark, sf)
    return M.orphan_files(f, s.where("kind = 'enum'"), s.where("kind = 'enum_constant'")).select("id", "config_hash", "path")


@query(f"""WITH {BOTH} SELECT 'symbols without file' AS check_name, count(*) AS bad FROM sym s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.config_hash = s.config_hash AND f.id = s.file_id)
UNION ALL SELECT 'symbols repeated', count(*) FROM (SELECT config_hash, usr FROM sym GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'references repeated', count(*) FROM (SELECT config_hash, to_usr, from_file, from_line, from_col, ref_kind, from_usr, slot_index FROM rf GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'references from unknown', count(*) FROM rf r WHERE from_usr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.config_hash = r.config_hash AND s.usr = r.from_usr)
UNION ALL SELECT 'definitions without end', count(*) FROM sym WHERE is_definition = 1 AND end_line < line""")
def integrity(spark, sf):
    return M.integrity(sym(spark, sf), ref(spark, sf), load(spark, sf, "files"))


@query(f"""WITH {_RUNS}, a AS (SELECT DISTINCT config_hash, run_no, path, content_hash FROM now_), b AS (SELECT DISTINCT config_hash, run_no, path, content_hash FROM was_)
SELECT coalesce(a.config_hash, b.config_hash) AS config_hash, coalesce(a.run_no, b.run_no) AS run_no, coalesce(a.path, b.path) AS path, a.content_hash AS now, b.content_hash AS was
FROM a FULL JOIN b ON a.config_hash = b.config_hash AND a.run_no = b.run_no AND a.path = b.path WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def modified_files(spark, sf):
    now, was = M.against_last(load(spark, sf, "files"), load(spark, sf, "index_runs"))
    return M.modified_files(now, was, ["config_hash", "run_no", "path"], "content_hash")
