"""Queries of sources, sinks and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import pointsto as P
from quarrylens.queries.common import BOTH, SYM, ref, sym
from quarrylens.runtime import load, scratch_path
from quarrylens.sources import build as B
from quarrylens.sources import sinks as K
from quarrylens.streaming import watch as W

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""SELECT config_hash, path, id, run_no, source_hash FROM files QUALIFY row_number() OVER (PARTITION BY config_hash, path ORDER BY run_no DESC, seen_at DESC) = 1""")
def streamed_state(spark, sf):
    """Structured Streaming: the newest listing of every file after an availableNow run."""
    return W.replay(spark, sf, scratch_path(spark, "stream")).select("config_hash", "path", "id", "run_no", "source_hash")


@query(f"WITH {BOTH} SELECT 'symbol' AS kind, config_hash, count(*) AS n FROM sym GROUP BY 2 UNION ALL SELECT 'ref', config_hash, count(*) FROM rf GROUP BY 2")
def exported_rows(spark, sf):
    return K.export_rows(sym(spark, sf), ref(spark, sf)).groupBy("kind", "config_hash").agg(F.count("json").alias("n"))


@query(f"""WITH {BOTH} SELECT 'symbol' AS kind, s.config_hash, s.usr, s.name, s.kind AS detail, s.file_path AS file, s.line::VARCHAR AS line FROM sym s
UNION ALL SELECT 'ref', r.config_hash, r.to_usr, c.qualified_name, r.ref_kind, r.from_file, r.from_line::VARCHAR FROM rf r LEFT JOIN sym c ON c.config_hash = r.config_hash AND c.usr = r.from_usr""")
def exported_json(spark, sf):
    """The JSON lines as they were written and read again, by their fields."""
    path = scratch_path(spark, "export")
    K.export_json(sym(spark, sf), ref(spark, sf), path)
    rows = spark.read.schema("value string, config_hash string, kind string").text(path)
    pick = lambda a, b: F.coalesce(F.get_json_object("value", f"$.{a}"), F.get_json_object("value", f"$.{b}"))
    name = F.when(F.col("kind") == "symbol", F.get_json_object("value", "$.name")).otherwise(F.get_json_object("value", "$.caller"))
    return rows.select("kind", "config_hash", pick("usr", "to_usr").alias("usr"), name.alias("name"), pick("symbol_kind", "ref_kind").alias("detail"), pick("file_path", "from_file").alias("file"), pick("line", "from_line").alias("line"))


@query("SELECT project_id, upper(name) AS name, root_path FROM projects")
def registry_upsert(spark, sf):
    p = load(spark, sf, "projects")
    return K.register(p, p.withColumn("name", F.upper("name")))


@query(f"""WITH {SYM}, r(entry_name, callee_name, slot_index) AS (VALUES ('sched_lock_enter', 'trace_emit', 0), ('board_bringup_all', NULL, 1))
SELECT e.config_hash, e.usr AS entry, t.usr AS target, 'P|' || e.usr || '|' || r.slot_index AS slot FROM sym e JOIN r ON r.entry_name = e.name LEFT JOIN sym t ON t.config_hash = e.config_hash AND t.name = r.callee_name""")
def sdk_links(spark, sf):
    rules = spark.createDataFrame([("sched_lock_enter", "trace_emit", 0, "call", "rtos"), ("board_bringup_all", None, 1, "call", "rtos")], "entry_name string, callee_name string, slot_index int, kind string, sdk string")
    return P.sdk_links(sym(spark, sf), rules).select("config_hash", "entry", "target", "slot")


@query()
def body_ends(spark, sf):
    return sym(spark, sf).where("source is not null").select("id", B.body_end(F.col("source"), F.lit(0)).alias("end_row"))


@query(f"""WITH {SYM}, n AS (SELECT config_hash, link_name, min(usr) AS function FROM sym WHERE link_name <> '' GROUP BY 1, 2 HAVING count(DISTINCT usr) = 1)
SELECT config_hash, 'V|vector_table' AS slot, function FROM n WHERE link_name IN ('trace_emit', 'vector_demux', 'board_bringup_all')""")
def interrupt_sources(spark, sf):
    facts = spark.createDataFrame([("V|vector_table", n) for n in ("trace_emit", "vector_demux", "board_bringup_all")], "slot string, link_name string")
    return B.interrupt_sources(facts, sym(spark, sf))
