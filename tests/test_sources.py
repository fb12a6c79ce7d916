"""Sources, sinks and streaming on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from quarrylens import schemas
from quarrylens.operators import merge as M
from quarrylens.operators import text as T
from quarrylens.operators import fusion as V
from quarrylens.operators import intervals, paging, pointsto
from quarrylens.sources import build as B
from quarrylens.sources.manifests import Manifests
from quarrylens.sources import sinks as K
from quarrylens.streaming import watch as W


@pytest.mark.parametrize("text, value", [
    ("0x20000000 + 16K", 0x20000000 + 16384), ("160k - 0x194", 160 * 1024 - 0x194), ("010K", 8192), ("09K", None), ("1 << 4 | 3", 19), ("7 / 2", 3), ("-7 / 2", -4), ("1 / 0", None),
    ("ORIGIN(RAM)", None), ("~0 & 0xff", 255), ("2 + 3 * 4", 14), ("(2 + 3) * 4", 20), ("10 - 3 - 2", 5), ("", None), (None, None), ("1 +", None), ("6 % 4 ^ 1", 3), ("1 << 5000", None),
])
def test_constants(text, value):
    assert B.constant(text) == value


def test_linker_script(spark, tmp_path):
    (tmp_path / "a.ld").write_text("/* MEMORY { X : ORIGIN = 1, LENGTH = 2 } */\nENTRY(Reset_Handler)\nMEMORY\n{\n  FLASH (rx) : ORIGIN = 0x08000000, LENGTH = 512K\n  RAM (xrw) : ORIGIN = 0x20000000, LENGTH = LD_SIZE\n}\n_estack = 0x20001000;\nPROVIDE(_heap = 0x100);\n")
    got = {r["name"]: (r["attributes"], r["origin_value"], r["length_value"]) for r in B.memory_regions(spark, str(tmp_path)).collect()}
    assert got == {"FLASH": ("rx", 0x08000000, 512 * 1024), "RAM": ("xrw", 0x20000000, None)}
    sym = {(r["name"], r["provided"], r["is_entry"]) for r in B.linker_symbols(spark, str(tmp_path)).collect()}
    assert {("_estack", False, False), ("_heap", True, False), ("Reset_Handler", False, True)} <= sym


def test_compile_database_and_dependencies(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"directory": "/b", "file": "x.c", "arguments": ["cc", "-O2", "-c", "x.c", "-o"]}, {"directory": "/b", "file": "/y.c", "command": "cc  -O2 -c /y.c"}]))
    rows = {r["file"]: r for r in B.compile_database(spark, str(tmp_path / "c.json")).collect()}
    assert set(rows) == {"/b/x.c", "/y.c"} and rows["/b/x.c"]["flags_hash"] == rows["/y.c"]["flags_hash"]
    (tmp_path / "d.d").write_text("x.o: x.c a\\ b.h \\\n  c.h\n")
    assert {(r["target"], r["header"]) for r in B.dependency_files(spark, str(tmp_path / "d.d")).collect()} == {("x.o", "x.c"), ("x.o", "a b.h"), ("x.o", "c.h")}
    (tmp_path / "m.txt").write_text("#define A 1\n#define F(x, y) (x)\nint a;\n")
    assert {tuple(r) for r in B.macro_definitions(spark, str(tmp_path / "m.txt")).collect()} == {("A", "", "1", 0), ("F", "x, y", "(x)", 1)}


def elf(entries):
    names = b"\0.intList\0.shstrtab\0"
    body = struct.pack("<II", len(entries), 0) + b"".join(struct.pack("<iIII", *e) for e in entries)
    head = 52
    sections = [(0, 0, 0), (1, head, len(body)), (10, head + len(body), len(names))]
    table = b"".join(struct.pack("<IIIIIIIIII", n, 1, 0, 0, off, size, 0, 0, 0, 0) for n, off, size in sections)
    start = head + len(body) + len(names)
    header = b"\x7fELF\x01\x01\x01" + b"\0" * 9 + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, 0, 0, start, 0, 52, 0, 0, 40, 3, 2)
    return header + body + names + table


def test_interrupt_list(spark, tmp_path):
    (tmp_path / "a.elf").write_bytes(elf([(3, 1, 0x100, 0), (-1, 0, 0x200, 7)]))
    (tmp_path / "b.elf").write_bytes(b"\x7fELF\x01\x01broken")
    assert {(r["irq"], r["handler"], r["argument"]) for r in B.interrupt_list(spark, str(tmp_path)).collect()} == {(3, 0x100, 0), (-1, 0x200, 7)}


def test_braces_and_skipped_ranges(spark):
    assert B.closing_line('int f() {\n  // }\n  s = "}";\n  if (x) {\n  }\n}\nint g;') == 5
    assert B.closing_line("no braces\nat all\nhere\nend") == 2 and B.closing_line("x", 4) == 4
    files = spark.createDataFrame([("g", "a.c", "1\n2\n3\n4"), ("g", "b.c", "1\n2")], "config_hash string, path string, content string")
    ranges = spark.createDataFrame([("g", "a.c", 2, 3)], "config_hash string, path string, first int, last int")
    assert {r["path"]: r["content"] for r in B.blank_skipped(files, ranges).collect()} == {"a.c": "1\n\n\n4", "b.c": "1\n2"}


def test_replace_table_and_export(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    K.replace_table(spark.range(3).toDF("a"), path)
    K.replace_table(spark.range(5).toDF("a"), path)
    held = K.read_table(spark, path)
    assert held.count() == 5 and {p.name for p in tmp_path.iterdir()} == {"t"}
    K.replace_table(held.where("a > 1"), path)
    assert K.read_table(spark, path).count() == 3 and held.count() == 5 and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert not Manifests(spark, f"{path}/versions").publish(1, {}) and K.read_table(spark, path).count() == 3
    K.drop_table(spark, path)
    K.drop_table(spark, path)
    assert K.read_table(spark, path) is None and not list(tmp_path.iterdir())


def test_facts_vectors_and_export(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    rows = spark.createDataFrame([("g", 1), ("h", 2)], "config_hash string, a int")
    K.write_facts({"flows": rows}, path)
    K.write_facts({"flows": rows.where("config_hash = 'g'").withColumn("a", F.lit(7))}, path)
    assert sorted((r["config_hash"], r["a"]) for r in spark.read.parquet(f"{path}/flows").collect()) == [("g", 7), ("h", 2)]
    old = spark.createDataFrame([(1, "a", 0, [1.0]), (1, "a", 1, [2.0])], "donor_id long, content_hash string, chunk_index int, embedding array<float>")
    new = spark.createDataFrame([(1, "a", 0, [9.0]), (1, "a", 1, None), (2, "a", 0, [3.0])], old.schema)
    assert sorted((r[0], r[2], list(r[3])) for r in K.upsert_vectors(old, new).collect()) == [(1, 0, [9.0]), (1, 1, [2.0]), (2, 0, [3.0])]
    symbols = spark.createDataFrame([("g", "u", "n", "q", "function", "f.c", 1, None, 1)], "config_hash string, usr string, name string, qualified_name string, kind string, file_path string, line int, signature string, is_definition int")
    refs = spark.createDataFrame([("g", "v", "u", "f.c", 3, "call")], "config_hash string, to_usr string, from_usr string, from_file string, from_line int, ref_kind string")
    K.export_json(symbols, refs, f"file://{tmp_path}/out")
    told = {r["kind"]: json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/out").collect()}
    assert told["symbol"]["symbol_kind"] == "function" and "signature" not in told["symbol"]
    assert told["ref"] == {"to_usr": "v", "from_usr": "u", "caller": "q", "from_file": "f.c", "from_line": 3, "ref_kind": "call"}


def test_stream_is_idempotent(spark, sf, tmp_path):
    want = W.replay(spark, sf, f"file://{tmp_path}")
    first = sorted(map(str, want.collect()))
    state = W.ListingState(spark, f"file://{tmp_path}/state")
    state.apply(spark.read.parquet(f"file://{tmp_path}/in"), 7)
    assert sorted(map(str, state.rows().collect())) == first
    state.apply(spark.read.parquet(f"file://{tmp_path}/in").limit(3), 7)
    state.compact()
    state.compact()
    assert sorted(map(str, state.rows().collect())) == first and len(state.store.commits()) == 1
    stream = W.listing_stream(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema)
    q = W.change_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(listings) from counts").first()[0] == spark.read.parquet(f"{sf}/files.parquet").count()


def test_schemas(spark):
    assert len(schemas.schema_version()) == 64
    df = schemas.conform(spark.createDataFrame([(1, "x")], "id int, extra string"), "refs")
    assert df.schema == schemas.schema("refs") or [f.name for f in df.schema] == [f.name for f in schemas.schema("refs")]
    assert "to_usr" in schemas.missing_columns(spark.range(1), "refs")


def test_query_language():
    assert T.expand_query("uart::init a-b") == 'uart* OR init* OR "a-b"'
    assert T.expand_query("a b", body=True) == "a b"
    tree = T.parse_query('name:foo* AND ("x y" OR z) NOT w')
    assert tree.op == "not" and [t.words for t in tree.terms()] == [("foo",), ("x", "y"), ("z",), ("w",)]
    assert tree.terms()[0].prefix and tree.terms()[0].column == "name"
    with pytest.raises(ValueError):
        T.parse_query("a AND")
    assert T.query_terms('"ret" AND fo* x') == ["ret", "fo"]


def test_cut_body():
    text = "a;\nb {\n}\n\nccc\n" + "x" * 25
    pieces = V.cut_body(text, 10)
    assert all(len(p) <= 10 for p in pieces) and pieces[0] == "a;\nb {\n}" and "".join(pieces).replace("\n", "") == text.replace("\n", "")
    assert V.cut_body("short", 10) == ["short"]


def test_points_to_passes_arguments(spark):
    none = ("g", "f.c", 1, 1)
    src = spark.createDataFrame([(*none, "cb", "void()", "V|table", "u"), (*none, "run", "void(fn)", "V|api", "u")], schemas.schema("slot_sources"))
    flow = spark.createDataFrame([(*none, "V|table", "V|copy", "u"), (*none, "V|copy", "V|table", "u")], schemas.schema("slot_flows"))
    site = spark.createDataFrame([("g", "f.c", 5, 1, 0, "main", "pointer", "V|api", "void(fn)", "", "", "u"), ("g", "f.c", 9, 1, 0, "run", "pointer", "P|run|0", "void()", "", "", "u"),
                                  ("g", "f.c", 12, 1, 0, "idle", "pointer", "", "void()", "", "", "u"), ("g", "f.c", 13, 1, 0, "idle", "address", "V|table", "void()", "", "", "u")], schemas.schema("slot_sites"))
    args = spark.createDataFrame([("g", "f.c", 5, 1, 0, 0, "slot", "V|copy", "u")], schemas.schema("slot_arguments"))
    got = pointsto.resolve_slots(src, flow, site, args)
    assert {(r["line"], r["function"], r["type_only"]) for r in got.edges.collect()} == {(5, "run", False), (9, "cb", False), (12, "cb", True)}
    assert {(r["slot"], r["function"], r["via"]) for r in got.via.collect()} >= {("V|table", "cb", ""), ("V|copy", "cb", "V|table"), ("P|run|0", "cb", "V|copy")}
    places = pointsto.stored_places(got.via, src, site.where("slot = 'P|run|0'").select("config_hash", "slot"))
    assert {(r["function"], r["line"]) for r in places.collect()} == {("cb", 1)}
    refs = pointsto.call_refs(got.edges, site)
    assert {(r["from_usr"], r["to_usr"], r["origins"]) for r in refs.collect()} == {("main", "run", 32), ("run", "cb", 32), ("idle", "cb", 64)}


def test_merges(spark):
    a = spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int")
    b = spark.createDataFrame([("k", 9), ("m", 3)], "key string, v int")
    assert dict(map(tuple, M.cache_put(a, b, "key").collect())) == {"k": 1, "l": 2, "m": 3}
    assert dict(map(tuple, M.cache_put(a, b, "key", overwrite=True).collect())) == {"k": 9, "l": 2, "m": 3}
    assert dict(map(tuple, M.replace_files(a, b, ["key"]).collect())) == {"k": 9, "l": 2, "m": 3}
    n = spark.createDataFrame([("g", x) for x in (1, 2, 3, 7, 9, 10)], "k string, n int")
    assert paging.number_ranges(n, ["k"], "n").first()["ranges"] == "1-3, 7, 9-10"
    pts = spark.createDataFrame([(1, "g", "a.c", 5), (2, "g", "a.c", 500)], "id int, config_hash string, from_file string, from_line int")
    rng = spark.createDataFrame([("g", "a.c", 1, 1000, "outer"), ("g", "a.c", 5, 5, "inner")], "config_hash string, from_file string, lo int, hi int, usr string")
    assert {(r["id"], r["usr"]) for r in intervals.contain(pts, rng, ["config_hash", "from_file"], "from_line", "lo", "hi").collect()} == {(1, "outer"), (1, "inner"), (2, "outer")}
    assert F is not None


def test_pagerank_converges(spark, sf):
    from quarrylens.operators.callgraph import pagerank
    from quarrylens.queries.common import ref, sym

    s, r = sym(spark, sf), ref(spark, sf)
    a = {(x["config_hash"], x["usr"]): x["pagerank"] for x in pagerank(s, r).collect()}
    b = {(x["config_hash"], x["usr"]): x["pagerank"] for x in pagerank(s, r, rounds=20, tolerance=0, stride=4).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3 and max(a.values()) == 1.0


def test_ranking_by_hand(spark):
    rows = [(1, "spi init", "starts the bus"), (2, "uart init", "spi spi spi"), (3, "adc", None), (4, "", "")]
    index = T.build_index(spark.createDataFrame(rows, "id long, name string, doc string"), "id", ("name", "doc"))
    assert index.docs == 4 and index.average == 2.75
    got = {r["doc"]: r["score"] for r in T.search(index, "spi", {"name": 2.0}).collect()}
    import math

    idf = max(math.log((4 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    want = {1: 2.0, 2: 3.0}
    for d, f in want.items():
        assert got[d] == pytest.approx(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * 5 / 2.75)))
    assert {r["doc"] for r in T.search(index, 'name:init NOT "the bus"').collect()} == {2}
    both = T.two_style_search(index, "spi init", spark.createDataFrame([(2,)], "doc long"), tokens="name").orderBy("place").collect()
    assert [r["doc"] for r in both] == [2, 1]


def elf_with_names(handler, name=b"my_isr"):
    """A 32-bit ELF file with one interrupt registration and one function."""
    names = b"\0.intList\0.symtab\0.strtab\0.shstrtab\0"
    strings = b"\0" + name + b"\0"
    ints = b"\0" * 8 + struct.pack("<iIII", 5, 0, handler | 1, 77)
    table = b"\0" * 16 + struct.pack("<IIIBBH", 1, handler | 1, 4, 2, 0, 1)
    at = 52
    places, body = [], b""
    for part in (ints, table, strings, names):
        places.append((at + len(body), len(part)))
        body += part
    kinds = [(1, 1, 0), (10, 2, 3), (18, 3, 0), (26, 3, 0)]
    heads = b"\0" * 40 + b"".join(struct.pack("<IIIIIIIIII", n, k, 0, 0, off, size, link, 0, 0, 0) for (n, k, link), (off, size) in zip(kinds, places))
    head = b"\x7fELF\x01\x01\x01" + b"\0" * 9 + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, 0, 0, at + len(body), 0, 52, 0, 0, 40, 5, 4)
    return head + body + heads


def test_interrupt_handlers_by_name(spark, tmp_path):
    (tmp_path / "a.elf").write_bytes(elf_with_names(0x8000100))
    (tmp_path / "b.elf").write_bytes(b"no elf")
    got = [(r["irq"], r["link_name"], r["argument"]) for r in B.interrupt_handlers(spark, str(tmp_path)).collect()]
    assert got == [(5, "my_isr", 77)]
    assert [(r["irq"], r["handler"] & ~1) for r in B.interrupt_list(spark, str(tmp_path)).collect()] == [(5, 0x8000100)]


def test_rules_values_and_checks(spark):
    rules = B.sdk_rules(spark, '[[call_graph.sdk]]\nsdk = "rtos"\nentry = "start"\ncallee = "run"\n[[call_graph.sdk]]\nentry = "loop"\nslot = 2\n').collect()
    assert [tuple(r) for r in rules] == [("start", "run", 0, "call", "rtos"), ("loop", None, 2, "call", "")]
    assert B.sdk_rules(spark, "x = 1").count() == 0
    sym = spark.createDataFrame([("_top", False, "BASE + 4K"), ("_heap", True, "0x100"), ("_bad", False, "other")], "name string, provided boolean, value_text string")
    got = {r["name"]: r["value"] for r in B.linker_values(sym, {"BASE": 0x1000, "_heap": 64}).collect()}
    assert got == {"_top": 0x2000, "_heap": 64, "_bad": None}
    with pytest.raises(ValueError, match="no to_usr"):
        schemas.quick_check(spark.range(1), "refs")


def test_names_lengths_and_cuts(spark):
    from quarrylens.functions import scalars as S
    from quarrylens.operators import merge

    rows = spark.createDataFrame([("int t[4]", "a/very/long/path/to/some/file/in/a/deep/tree/of/folders/name_of_the_file.c", "a.b_x"), ("int u[2][3]", "short.c", "axb"), ("int v", None, "spi_Init")], "t string, p string, n string")
    got = rows.select(S.declared_length(F.col("t")).alias("l"), S.middle_cut(F.col("p")).alias("p"), S.stem_matches(F.col("n"), "a.b").alias("dot"), S.stem_matches(F.col("n"), "SPI").alias("spi"), S.stem_matches(F.col("n"), "(").alias("open")).collect()
    assert [r["l"] for r in got] == [4, None, None] and len(got[0]["p"]) == 60 and got[1]["p"] == "short.c" and got[2]["p"] is None
    assert [r["dot"] for r in got] == [True, False, False] and [r["spi"] for r in got] == [False, False, True] and not any(r["open"] for r in got)
    chain = spark.createDataFrame([("g", f"m{i:02d}", f"m{i + 1:02d}") for i in range(60)], "config_hash string, derived_usr string, base_usr string")
    from quarrylens.operators.callgraph import close_overrides, walk
    assert close_overrides(chain).count() == 60 * 61 // 2
    edges = chain.select("config_hash", F.col("derived_usr").alias("src"), F.col("base_usr").alias("dst"))
    assert walk(edges, spark.createDataFrame([("g", "m00")], "config_hash string, usr string"), None).agg(F.max("depth")).first()[0] == 60
    old = spark.createDataFrame([("g", "u", 1, 1, None, "a.c", 5, 0, 0), ("g", "u", 2, 0, None, "b.c", 9, 0, 0)], "config_hash string, usr string, id long, is_definition int, removed_at timestamp, file_path string, seen int, is_weak int, is_tentative int")
    old = old.withColumn("seen_at", F.timestamp_seconds("seen"))
    assert merge.merge_symbols(old).first()["id"] == 1
    fresh = spark.createDataFrame([("g", "a.c", 7)], "config_hash string, file_path string, s int").select("config_hash", "file_path", F.timestamp_seconds("s").alias("since"))
    assert merge.merge_symbols(old, fresh).first()["id"] == 2
