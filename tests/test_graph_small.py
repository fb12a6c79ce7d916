"""Paths, exact neighbours, search steps and ranked pages on small tables, against brute force."""

import random
from itertools import pairwise

import numpy as np
from pyspark.sql import functions as F

from quarrylens.operators import callgraph as G
from quarrylens.operators import fusion as V
from quarrylens.operators import resolve as L
from quarrylens.operators import text as T

EDGE = "config_hash string, src string, dst string"


def all_paths(edges, a, b, depth):
    """The shortest paths from a to b by walking, in order."""
    front, seen = [[a]], {a}
    for _ in range(depth):
        front = sorted(p + [d] for p in front for s, d in edges if s == p[-1] and d not in seen)
        hit = [p for p in front if p[-1] == b]
        if hit:
            return hit
        seen |= {p[-1] for p in front}
    return []


def test_call_paths_equal_walking(spark):
    rnd = random.Random(4)
    edges = sorted({(f"n{rnd.randrange(14):02d}", f"n{rnd.randrange(14):02d}") for _ in range(40)} | {("n00", "n13"), ("n13", None)}, key=str)
    df = spark.createDataFrame([("g", *e) for e in edges] + [("h", "n00", "n01")], EDGE)
    known = [e for e in edges if e[1]]
    node = lambda *names: spark.createDataFrame([("g", n) for n in names], "config_hash string, usr string")
    for goal in ("n13", "n07", "n05"):
        paths, outcome = G.call_paths(df, node("n00"), node(goal), 6)
        want = all_paths(known, "n00", goal, 6)
        got = [r["path"] for r in paths.orderBy("rn").collect()]
        assert got == want[:5] and outcome.first()["outcome"] == ("found" if want else "not_found")
        assert all((a, b) in known for p in got for a, b in pairwise(p))
    assert G.call_paths(df, node("n00"), node("nowhere"), 6)[1].first()["outcome"] == "not_found"
    assert G.call_paths(df, node("n00"), node("nowhere"), 6, max_nodes=2)[1].first()["outcome"] == "capped"
    assert G.call_paths(df.limit(0), node("n00"), node("n01"))[0].count() == 0


def test_alias_edges_go_one_way_each(spark):
    calls = spark.createDataFrame([("g", "user", "decl"), ("g", "impl", "deep")], EDGE)
    pairs = spark.createDataFrame([("g", "decl", "impl")], "config_hash string, decl_usr string, def_usr string")
    edges = lambda forward: {(r["src"], r["dst"]) for r in G.alias_edges(calls, pairs, forward).collect()}
    assert edges(True) == {("user", "decl"), ("impl", "deep"), ("decl", "deep")}
    assert edges(False) == {("user", "decl"), ("impl", "deep"), ("user", "impl")}


def test_closure_of_rings_and_nothing(spark):
    ring = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("h", "a", "b"), ("g", "a", "b"), ("g", None, "a")], EDGE)
    got = {(r["config_hash"], r["src"], r["dst"]) for r in G.closure(ring).collect()}
    assert got == {("g", x, y) for x in "abc" for y in "abc"} | {("h", "a", "b")}
    assert G.closure(ring.limit(0)).count() == 0


def test_exact_neighbours_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((700, 8))
    x[50] = x[51]
    x[60] = 0
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(700)] + [(900, None, ""), (None, [1.0] * 8, ""), (901, [1.0] * 5, ""), (902, [2.0] * 5, ""), (903, [float("nan")] * 8, "")]
    df = spark.createDataFrame(rows, "id long, v array<float>, similarity string").repartition(5)
    got = {}
    for r in V.nearest_of(df.where("id % 50 = 0 or id > 900"), df, "id", "v", 4, wave=6).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["similarity"])
    u = x.astype("f4").astype("f8")
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=np.zeros_like(u), where=np.linalg.norm(u, axis=1, keepdims=True) > 0)
    for q in range(0, 700, 50):
        s = np.round(u @ u[q], 9)
        best = sorted((-s[j], j) for j in range(700) if j != q)[:4]
        assert [got[q][k][0] for k in (1, 2, 3, 4)] == [j for _, j in best]
    assert got[901] == {1: (902, 1.0)} and 900 not in got and all(i != 903 for near in got.values() for i, _ in near.values())
    assert V.nearest_of(df.limit(0), df, "id", "v", 4).count() == 0


def test_steps_of_a_search(spark):
    rows = [(1, "g", "u1", "spi_init", "spi init", "starts the bus", "function"), (2, "g", "u2", "uart_send", "uart send", "sends a byte", "method"), (3, "g", "u3", "adc_read", "adc read", None, "function")]
    symbols = spark.createDataFrame(rows, "id long, config_hash string, usr string, name string, name_tokens string, docstring string, kind string")
    index = T.build_index(symbols, "id", ("name", "name_tokens"), stored=True)
    macros = T.build_index(spark.createDataFrame([(7, "ZED_MAX")], "id long, name string"), "id", ("name",))
    step = lambda q, **k: (lambda s, df: (s, sorted(r["id"] for r in df.collect())))(*T.search_chain(index, symbols, macros, q, **k))
    assert step("spi", kind="function") == ("match", [1]) and step("uart", kind="function") == ("any_kind", [2])
    assert step("uart AND bogus") == ("name_tokens", [2]) and step("byte") == ("docstring", [2]) and step("zed") == ("macro", [7]) and step("nothing_at_all")[0] == "nothing"


def test_pages_of_a_lookup(spark):
    rows = [("g", f"u{i:03d}", "same", "same", i % 2, 5, "f.c", None, "function", None) for i in range(250)] + [("h", "x", "Same_too", "ns::Same_too", 1, 1, "g.c", "cls", "method", "void (int a)"), ("h", "cls", "Cls", "Cls", 1, 1, "g.c", None, "class", None)]
    s = spark.createDataFrame(rows, "config_hash string, usr string, name string, qualified_name string, is_definition int, line int, file_path string, parent_usr string, kind string, signature string")
    first, rest = L.lookup(s, "same"), L.lookup(s, "same", limit=100, offset=100)
    assert [r["usr"] for r in first.orderBy("rn").collect()] == [f"u{i:03d}" for i in range(1, 201, 2)]
    assert rest.agg(F.min("rn"), F.max("rn"), F.count("*")).first()[:] == (101, 200, 100) and L.lookup(s, "same", limit=9_999).count() == 100
    owned = L.with_owner(L.lookup(s, "SAME_T", exact=False), s).collect()
    assert [(r["usr"], r["owner"]) for r in owned] == [("x", "Cls")]
    labels = {r["usr"]: r["label"] for r in L.candidate_labels(s.where("config_hash = 'h'").unionByName(s.where("config_hash = 'h'").withColumn("usr", F.concat("usr", F.lit("2"))).withColumn("file_path", F.lit("k.c")))).collect()}
    assert labels["x"] == "ns::Same_too (g.c)" and labels["x2"] == "ns::Same_too (k.c)"
