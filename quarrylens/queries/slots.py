"""Queries of points-to operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import pointsto as P
from quarrylens.operators import references as R
from quarrylens.functions import scalars as S
from quarrylens.queries.common import BOTH, OVR, REF, SYM, overrides, ref, slot_facts, sym

_FACTS = f"""{REF}, src AS (SELECT DISTINCT config_hash, to_usr AS function, 'P|' || from_usr || '|' || slot_index AS slot FROM rf WHERE slot_index IS NOT NULL AND from_usr IS NOT NULL),
flow AS (SELECT DISTINCT config_hash, 'P|' || from_usr || '|0' AS source, 'P|' || to_usr || '|0' AS target FROM rf WHERE ref_kind = 'indirect' AND from_usr IS NOT NULL),
site AS (SELECT DISTINCT config_hash, from_file AS file, from_line AS line, from_col AS col, 'P|' || from_usr || '|0' AS slot, from_usr AS caller, to_usr AS callee FROM rf WHERE ref_kind = 'indirect' AND from_usr IS NOT NULL)"""
_PT = f"""{_FACTS}, pt AS (SELECT config_hash, slot, function FROM src UNION SELECT pt.config_hash, f.target, pt.function FROM pt JOIN flow f ON f.config_hash = pt.config_hash AND f.source = pt.slot WHERE f.source <> f.target)"""

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _resolved(spark, sf):
    f = slot_facts(spark, sf)
    return P.resolve_slots(f["sources"], f["flows"], f["sites"]), f


@query(f"WITH RECURSIVE {_PT} SELECT config_hash, slot, function FROM pt")
def points_to(spark, sf):
    return _resolved(spark, sf)[0].targets.select("config_hash", "slot", "function")


@query(f"""WITH RECURSIVE {_PT} SELECT config_hash, slot, function, '' AS via FROM src
UNION SELECT pt.config_hash, f.target, pt.function, pt.slot FROM pt JOIN flow f ON f.config_hash = pt.config_hash AND f.source = pt.slot WHERE f.source <> f.target""")
def points_to_via(spark, sf):
    return _resolved(spark, sf)[0].via.select("config_hash", "slot", "function", "via")


@query(f"""WITH RECURSIVE {_PT} SELECT DISTINCT s.config_hash, s.file, s.line, s.col, pt.function FROM site s JOIN pt ON pt.config_hash = s.config_hash AND pt.slot = s.slot
UNION SELECT config_hash, file, line, col, callee FROM site""")
def indirect_targets(spark, sf):
    return _resolved(spark, sf)[0].edges.select("config_hash", "file", "line", "col", "function").distinct()


@query(f"""WITH RECURSIVE {_FACTS}, w AS (SELECT config_hash, source AS start_slot, target AS slot FROM flow WHERE source <> target
UNION SELECT w.config_hash, w.start_slot, f.target FROM w JOIN flow f ON f.config_hash = w.config_hash AND f.source = w.slot WHERE f.source <> f.target) SELECT config_hash, start_slot, slot FROM w""")
def slot_reach(spark, sf):
    f = slot_facts(spark, sf)["flows"]
    return P.reach(f, f.select("config_hash", F.col("source").alias("slot"))).select("config_hash", F.col("target").alias("start_slot"), F.col("usr").alias("slot"))


@query(f"""WITH {_FACTS} SELECT config_hash, slot, count(*) AS sites, count(DISTINCT caller) AS callers FROM site GROUP BY 1, 2""")
def indirect_sites(spark, sf):
    return P.site_counts(slot_facts(spark, sf)["sites"])


@query(f"""WITH {REF} SELECT config_hash, from_line AS line, from_usr AS caller, ref_kind, slot_index, to_usr, min(from_file) AS unit FROM rf GROUP BY ALL""")
def one_unit_sites(spark, sf):
    """Bound: the copies of a site are the references of one caller and line to one target, their units the files."""
    r = ref(spark, sf).select("config_hash", F.col("from_line").alias("line"), F.col("from_usr").alias("caller"), "ref_kind", "slot_index", "to_usr", F.col("from_file").alias("unit"))
    return R.one_unit_sites(r, [c for c in r.columns if c != "unit"])


@query(f"""WITH {_FACTS} SELECT s.config_hash, s.file, s.line, s.col, s.caller, r.to_usr FROM site s JOIN rf r ON r.config_hash = s.config_hash AND r.from_file = s.file AND r.from_line = s.line
AND r.from_col = s.col AND r.from_usr IS NOT DISTINCT FROM s.caller WHERE (r.origins & 33) <> 0""")
def site_targets(spark, sf):
    sites = slot_facts(spark, sf)["sites"].select("config_hash", "file", "line", "col", "caller", "callee").distinct()
    return R.site_targets(sites, ref(spark, sf), 33).select("config_hash", "file", "line", "col", "caller", "to_usr")


@query(f"""WITH {BOTH} SELECT r.id, r.to_usr, r.from_usr, s.name AS caller_name FROM rf r LEFT JOIN sym s ON s.config_hash = r.config_hash AND s.usr = r.from_usr WHERE (r.origins & 32) <> 0""")
def function_calls_by_slot(spark, sf):
    r = ref(spark, sf).where(S.has_origin(F.col("origins"), "slot"))
    return R.as_side(sym(spark, sf), "caller", "from_usr").join(r, ["config_hash", "from_usr"], "right").select("id", "to_usr", "from_usr", "caller_name")


_VECTORS = f"""WITH {BOTH}, d AS (SELECT DISTINCT config_hash, from_usr AS usr FROM rf WHERE ref_kind = 'indirect'), e AS (SELECT DISTINCT config_hash, from_file, slot_index, to_usr FROM rf WHERE ref_kind = 'vector' AND slot_index IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY config_hash, from_file, to_usr) AS n FROM e)
SELECT c.config_hash, c.from_file, c.slot_index, c.to_usr, CASE WHEN starts_with(c.to_usr, 'ld:') THEN 'linker' WHEN NOT starts_with(c.to_usr, 'asm:') AND n > 1 AND d.usr IS NOT NULL THEN 'dispatcher'
WHEN NOT starts_with(c.to_usr, 'asm:') THEN 'c' WHEN EXISTS (SELECT 1 FROM rf a WHERE a.ref_kind = 'alias' AND a.config_hash = c.config_hash AND a.from_usr = c.to_usr) THEN 'unhandled'
WHEN n > 1 AND d.usr IS NOT NULL THEN 'dispatcher' ELSE 'assembly' END AS status
FROM c LEFT JOIN d ON d.config_hash = c.config_hash AND d.usr = c.to_usr"""


@query(_VECTORS)
def vector_table(spark, sf):
    r = ref(spark, sf)
    return P.vector_table(r, sym(spark, sf), r.where("ref_kind = 'indirect'").select("config_hash", F.col("from_usr").alias("usr")))


@query(f"""SELECT v.config_hash, from_file, v.slot_index, to_usr, CASE WHEN status = 'unhandled' AND EXISTS (SELECT 1 FROM refs r WHERE r.config_hash = v.config_hash AND r.slot_index = v.slot_index AND r.ref_kind = 'call') THEN 'runtime' ELSE status END AS status FROM ({_VECTORS}) v""")
def vector_table_runtime(spark, sf):
    """With registrations, bound to calls that carry a slot index."""
    r = ref(spark, sf)
    registered = r.where("ref_kind = 'call' and slot_index is not null").select("config_hash", "slot_index")
    return P.vector_table(r, sym(spark, sf), r.where("ref_kind = 'indirect'").select("config_hash", F.col("from_usr").alias("usr")), registered)


@query(f"""WITH RECURSIVE {_PT}, via AS (SELECT pt.config_hash, f.target AS slot, pt.function, pt.slot AS via FROM pt JOIN flow f ON f.config_hash = pt.config_hash AND f.source = pt.slot WHERE f.source <> f.target),
w AS (SELECT DISTINCT pt.config_hash, pt.slot AS start_slot, pt.function, pt.slot FROM pt JOIN site s ON s.config_hash = pt.config_hash AND s.slot = pt.slot
UNION SELECT w.config_hash, w.start_slot, w.function, v.via FROM w JOIN via v ON v.config_hash = w.config_hash AND v.slot = w.slot AND v.function = w.function),
n AS (SELECT config_hash, start_slot, function, count(*) AS n FROM w GROUP BY 1, 2, 3)
SELECT DISTINCT w.config_hash, w.start_slot, w.function, r.from_file AS file, r.from_line AS line, n.n > 256 AS capped FROM w JOIN n ON n.config_hash = w.config_hash AND n.start_slot = w.start_slot AND n.function = w.function
JOIN rf r ON r.config_hash = w.config_hash AND r.to_usr = w.function AND r.slot_index IS NOT NULL AND 'P|' || r.from_usr || '|' || r.slot_index = w.slot""")
def stored_places(spark, sf):
    got, f = _resolved(spark, sf)
    return P.stored_places(got.via, f["sources"], f["sites"].select("config_hash", "slot"))


@query(f"""WITH {SYM}, {OVR}, {_FACTS}, i AS (SELECT DISTINCT config_hash, regexp_extract(slot, '^P\\|(.*)\\|[^|]*$', 1) AS code, regexp_extract(slot, '([^|]*)$', 1) AS k FROM src)
SELECT DISTINCT o.config_hash, 'P|' || base_usr || '|' || k AS source, 'P|' || derived_usr || '|' || k AS target FROM ovr o JOIN i ON i.config_hash = o.config_hash AND i.code IN (o.base_usr, o.derived_usr)
UNION ALL SELECT config_hash, 'R|' || derived_usr, 'R|' || base_usr FROM ovr""")
def override_flows(spark, sf):
    return P.override_flows(overrides(spark, sf), slot_facts(spark, sf)["sources"])


@query(f"""WITH {_FACTS} SELECT DISTINCT slot, CASE WHEN starts_with(slot, 'P|') THEN 'parameter ' || regexp_extract(slot, '([^|]*)$', 1) || ' of ' || regexp_extract(slot, '^.\\|([^|]*)', 1) ELSE slot END AS label FROM src""")
def slot_labels(spark, sf):
    return slot_facts(spark, sf)["sources"].select("slot", S.describe_slot(F.col("slot")).alias("label")).distinct()


# --- points-to with arguments, overrides and escapes


#: Bound to references: one with a slot index stores its target into a parameter of its source, one in four of the indexes
#: each; indirect ones are sites, of C++ files without a slot, and flows between first parameters; every site passes its caller
#: and the caller's second parameter on; targets of interrupt tables escape, and so does the return value of every caller that
#: the build doesn't define.
_FULL = f"""{BOTH}, {OVR}, src0 AS (SELECT DISTINCT config_hash, 'P|' || from_usr || '|' || (slot_index // 16) AS slot, to_usr AS function FROM rf WHERE slot_index IS NOT NULL AND from_usr IS NOT NULL),
ty AS (SELECT DISTINCT config_hash, to_usr AS function FROM rf WHERE slot_index < 32 AND from_usr IS NOT NULL),
site AS MATERIALIZED (SELECT DISTINCT config_hash, from_file AS file, from_line AS line, from_col AS col, from_usr AS caller, CASE WHEN regexp_matches(from_file, '\\.(cpp|cc)$') THEN '' ELSE 'P|' || from_usr || '|0' END AS slot,
CASE WHEN (origins & 1) <> 0 THEN to_usr ELSE '' END AS callee FROM rf WHERE ref_kind = 'indirect' AND from_usr IS NOT NULL),
arg AS MATERIALIZED (SELECT DISTINCT config_hash, file, line, col, 1 AS k, caller AS fn, NULL::VARCHAR AS other FROM site UNION ALL SELECT DISTINCT config_hash, file, line, col, 0, NULL::VARCHAR, 'P|' || caller || '|1' FROM site),
raw AS (SELECT DISTINCT config_hash, 'P|' || from_usr || '|0' AS source, 'P|' || to_usr || '|0' AS target FROM rf WHERE ref_kind = 'indirect' AND from_usr IS NOT NULL
UNION SELECT DISTINCT config_hash, 'R|' || from_usr, 'P|' || from_usr || '|0' FROM rf WHERE ref_kind = 'indirect' AND from_usr IS NOT NULL),
named AS (SELECT config_hash, slot FROM src0 UNION SELECT config_hash, source FROM raw UNION SELECT config_hash, target FROM raw UNION SELECT config_hash, slot FROM site),
ix AS (SELECT DISTINCT config_hash, regexp_extract(slot, '^P\\|(.*)\\|[^|]*$', 1) AS code, regexp_extract(slot, '([^|]*)$', 1) AS k FROM named WHERE starts_with(slot, 'P|')),
flow0 AS MATERIALIZED (SELECT * FROM raw UNION SELECT o.config_hash, 'P|' || base_usr || '|' || k, 'P|' || derived_usr || '|' || k FROM ovr o JOIN ix ON ix.config_hash = o.config_hash AND ix.code IN (o.base_usr, o.derived_usr)
UNION SELECT config_hash, 'R|' || derived_usr, 'R|' || base_usr FROM ovr),
lost0 AS (SELECT DISTINCT config_hash, 'P|' || to_usr || '|0' AS slot FROM rf WHERE ref_kind = 'vector' UNION SELECT DISTINCT config_hash, 'R|' || from_usr FROM rf r WHERE ref_kind = 'indirect' AND from_usr IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM sym d WHERE d.config_hash = r.config_hash AND d.usr = r.from_usr AND d.is_definition = 1))"""


def _full_sql(rounds: int) -> str:
    """The outer fix point written out; it must have ended by then."""
    out = _FULL
    for i in range(rounds + 1):
        out += f""",
pt{i} AS (SELECT config_hash, slot, function FROM src{i} UNION SELECT p.config_hash, f.target, p.function FROM pt{i} p JOIN flow{i} f ON f.config_hash = p.config_hash AND f.source = p.slot WHERE f.source <> f.target),
esc{i} AS (SELECT config_hash, slot FROM lost{i} UNION SELECT e.config_hash, f.target FROM esc{i} e JOIN flow{i} f ON f.config_hash = e.config_hash AND f.source = e.slot WHERE f.source <> f.target),
ed{i} AS MATERIALIZED (SELECT DISTINCT s.config_hash, s.file, s.line, s.col, p.function, false AS type_only FROM site s JOIN pt{i} p ON p.config_hash = s.config_hash AND p.slot = s.slot WHERE s.slot <> ''
UNION SELECT config_hash, file, line, col, callee, false FROM site WHERE callee <> ''
UNION SELECT DISTINCT s.config_hash, s.file, s.line, s.col, t.function, true FROM site s JOIN ty t ON t.config_hash = s.config_hash
WHERE (s.slot = '' OR EXISTS (SELECT 1 FROM esc{i} e WHERE e.config_hash = s.config_hash AND e.slot = s.slot)) AND NOT EXISTS (SELECT 1 FROM pt{i} p WHERE p.config_hash = s.config_hash AND p.slot = s.slot AND p.function = t.function))"""
        if i < rounds:
            given = f"ed{i} e JOIN arg a ON a.config_hash = e.config_hash AND a.file = e.file AND a.line = e.line AND a.col = e.col"
            out += f""",
src{i + 1} AS MATERIALIZED (SELECT config_hash, slot, function FROM src{i} UNION SELECT e.config_hash, 'P|' || e.function || '|' || a.k, a.fn FROM {given} WHERE NOT type_only AND a.fn IS NOT NULL),
flow{i + 1} AS MATERIALIZED (SELECT config_hash, source, target FROM flow{i} UNION SELECT e.config_hash, a.other, 'P|' || e.function || '|' || a.k FROM {given} WHERE NOT type_only AND a.other IS NOT NULL),
lost{i + 1} AS MATERIALIZED (SELECT config_hash, slot FROM lost{i} UNION SELECT e.config_hash, 'P|' || e.function || '|' || a.k FROM {given} WHERE type_only)"""
    return f"WITH RECURSIVE {out}"


def _full(spark, sf) -> P.Resolution:
    r, s = ref(spark, sf), sym(spark, sf)
    held = r.where("from_usr is not null")
    at = [F.col("from_file").alias("file"), F.col("from_line").alias("line"), F.col("from_col").alias("col")]
    param = lambda c, i: F.concat(F.lit("P|"), F.col(c), F.lit("|"), i.cast("string"))
    zero = F.lit(0)
    stored = held.where("slot_index is not null")
    sources = stored.select("config_hash", param("from_usr", F.floor(F.col("slot_index") / 16)).alias("slot"), F.col("to_usr").alias("function"), F.when(F.col("slot_index") < 32, "T").otherwise("lambda").alias("function_type"))
    calls = held.where("ref_kind = 'indirect'")
    flows = calls.select("config_hash", param("from_usr", zero).alias("source"), param("to_usr", zero).alias("target")).unionByName(
        calls.select("config_hash", F.concat(F.lit("R|"), "from_usr").alias("source"), param("from_usr", zero).alias("target")))
    slot = F.when(F.col("from_file").rlike(r"\.(cpp|cc)$"), "").otherwise(param("from_usr", zero))
    sites = calls.select("config_hash", *at, zero.alias("ordinal"), F.col("from_usr").alias("caller"), F.lit("pointer").alias("kind"), slot.alias("slot"), F.lit("T").alias("slot_type"),
                         F.when(S.has_origin(F.col("origins"), "direct"), F.col("to_usr")).otherwise("").alias("callee"))
    place = calls.select("config_hash", *at, zero.alias("ordinal"), F.col("from_usr").alias("caller"))
    arguments = place.withColumns({"arg_index": F.lit(1), "value_kind": F.lit("function"), "value": F.col("caller")}).unionByName(
        place.withColumns({"arg_index": zero, "value_kind": F.lit("slot"), "value": param("caller", F.lit(1))}))
    escapes = r.where("ref_kind = 'vector'").select("config_hash", param("to_usr", zero).alias("slot"), F.lit("table").alias("reason")).unionByName(
        calls.select("config_hash", F.concat(F.lit("R|"), "from_usr").alias("slot"), F.lit("outside").alias("reason")))
    return P.resolve_slots(sources, flows, sites, arguments, overrides(spark, sf), escapes, s.where("is_definition = 1"))


_ROUNDS = 8


@query(f"""{_full_sql(_ROUNDS)} SELECT 'edge' AS part, config_hash, file || ':' || line || ':' || col AS place, function, type_only FROM ed{_ROUNDS}
UNION ALL SELECT 'target', config_hash, slot, function, NULL FROM pt{_ROUNDS} UNION ALL SELECT 'escaped', config_hash, slot, NULL, NULL FROM esc{_ROUNDS}""")
def points_to_full(spark, sf):
    """All that the resolution of these facts gives: edges of sites, targets of slots, escaped slots."""
    got = _full(spark, sf)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, part, place, function, only: df.select(F.lit(part).alias("part"), "config_hash", place.alias("place"), function.alias("function"), only.alias("type_only"))
    edges = row(got.edges, "edge", F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string")), F.col("function"), F.col("type_only"))
    return edges.unionByName(row(got.targets, "target", F.col("slot"), F.col("function"), none("boolean"))).unionByName(row(got.escaped, "escaped", F.col("slot"), none("string"), none("boolean")))
