"""The problems of training data on small tables: brute force, round trips, and the cases that the docstrings define."""


import random

from datetime import datetime

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.llm import bpe, docpairs, mixing, neighbours, queries, residue, survivors

# --- 8


@pytest.fixture(scope="module")
def encoder():
    return bpe._encoder(open(bpe.TOKENIZER, encoding="utf-8").read())


@pytest.fixture(scope="module")
def judge():
    ids = bpe.load_merges(open(bpe.TOKENIZER, encoding="utf-8").read())[1]
    return tiktoken.Encoding("judge", pat_str=bpe.WORDS, mergeable_ranks=ids, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="abtheirn  -=_'s\n", max_size=80), st.text(alphabet="é中🔧x ́", max_size=30)))
def test_ids_equal_another_tokenizer(encoder, judge, text):
    ids = encoder.encode(text)
    assert ids == judge.encode_ordinary(text)
    assert encoder.automaton.decode(ids) == text


def test_every_token_and_long_runs(encoder, judge):
    for t in ["=" * 5_000, "ab" * 3_000, "a" * 4_001, " " * 999, "<|endoftext|>", "\x00\x07", "\U0001f469‍\U0001f527"]:
        assert encoder.encode(t) == judge.encode_ordinary(t)
    rnd = random.Random(1)
    own = encoder.automaton
    for i in rnd.sample(sorted(own.label), 3_000):
        assert own.encode_word(own.label[i]) == [i]


def test_automaton_of_few_merges():
    """All strings of three letters against merging pair by pair."""
    letters = {bytes([b]): b for b in range(256)}
    rnd = random.Random(4)
    for _ in range(15):
        ids, merges, tokens = dict(letters), [], [b"a", b"b", b"c"]
        for _ in range(9):
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in ids:
                ids[u + v] = len(ids)
                merges.append((u, v))
                tokens.append(u + v)
        machine = bpe.MergeAutomaton(merges, ids)
        for _ in range(300):
            word = bytes(rnd.choices(b"abc", k=rnd.randint(1, 12)))
            parts = [bytes([x]) for x in word]
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert machine.encode_word(word) == [ids[p] for p in parts]


def test_encode_keeps_every_row(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "a b", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode(df).collect()), key=str)
    assert [g[1] for g in got].count([]) == 2 and len(got) == 4 and got[0][1] == got[-1][1] or len(got) == 4
    assert bpe.encode(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df.where("text is not null"))).select("doc_id", F.col("text").alias("t")).collect()
    assert sorted(r["t"] for r in back) == ["", "a b", "a b"]


# --- 9


def test_water_filling():
    assert mixing.fill([0.5, 0.5], [100, 100], 100) == [50, 50]
    assert mixing.fill([0.5, 0.5], [10, 200], 100) == [10, 90]
    assert mixing.fill([0.6, 0.3, 0.1], [10, 20, 5], 100) == [10, 20, 5]
    assert mixing.fill([0.5, 0.25, 0.25], [0, 1000, 30], 100) == pytest.approx([0, 70, 30])
    assert mixing.fill([], [], 5) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.floats(0, 100)), min_size=1, max_size=8), st.floats(1, 200))
def test_water_filling_is_feasible(sources, total):
    shares, caps = [s for s, _ in sources], [c for _, c in sources]
    got = mixing.fill(shares, caps, total)
    assert all(g <= c + 1e-6 for g, c in zip(got, caps))
    assert sum(got) == pytest.approx(min(total, sum(caps)), rel=1e-6, abs=1e-6)
    free = [g / s for g, s, c in zip(got, shares, caps) if g < c - 1e-6]
    assert max(free, default=0) - min(free, default=0) < 1e-6


def test_mixing_plan_and_sample(spark):
    docs = spark.createDataFrame([(i, "word " * 20, " Big") for i in range(200)] + [(1000 + i, "word " * 20, "small") for i in range(5)] + [(2000, "word " * 400, None), (2001, None, "big"), (2002, "", "big")],
                                 "doc_id long, text string, source string")
    goals = spark.createDataFrame([(1, "big", 0.5, 2), (1, "SMALL ", 0.5, 3), (2, "absent", 0.1, 9), (2, "big", 0.9, 1), (None, "big", 1.0, 1), (3, "big", None, None)],
                                  "mix_id int, source string, target_share double, max_repeats int")
    plan = {(r["mix_id"], r["source"]): r for r in mixing.mixing_plan(docs, goals).collect()}
    assert {k for k, r in plan.items() if not r["reachable"]} == {(1, "SMALL "), (2, "absent"), (2, "big")}
    assert plan[1, "SMALL "]["epochs"] == 3 and plan[1, "big"]["epochs"] <= 2 and (None, "big") not in plan
    drawn = mixing.sample(docs, mixing.mixing_plan(docs, goals))
    again = mixing.sample(docs.repartition(7), mixing.mixing_plan(docs, goals))
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    assert {r["copies"] for r in drawn.where("mix_id = 1 and doc_id between 1000 and 1999").collect()} == {3}
    report = {(r["mix_id"], r["source"]): r for r in mixing.mixing_report(docs, goals).collect()}
    assert report[1, "big"]["actual_share"] == pytest.approx(report[1, "big"]["planned_share"], abs=0.05)
    assert mixing.mixing_plan(docs.limit(0), goals).where("not reachable").count() == 0
    assert mixing.mixing_plan(docs, goals.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1000), st.integers(0, 4)), min_size=1, max_size=6), st.integers(0, 3000))
def test_targets_out_of_reach_are_those_clamped_below_their_share(sources, more):
    """What the water-filling leaves below its share by a cap is what the definition names, whatever the shares add up to."""
    import pandas as pd

    total = sum(t for _, t, _ in sources) + more
    mix = pd.DataFrame([(1, f"s{i}", f"s{i}", s, r, t, total, True, 0.0, 0.0) for i, (s, t, r) in enumerate(sources)],
                       columns=["mix_id", "source", "name", "target_share", "max_repeats", "tokens", "total", "reachable", "mixed_tokens", "epochs"])
    got = mixing._plan(mix)
    assert got["reachable"].tolist() == [not r * t < s * total for s, r, t in zip(got["target_share"], got["max_repeats"], got["tokens"])]


# --- 4

BODY = "int f(int mask) {\n  return mask; // { not this\n}"


@pytest.mark.parametrize("doc, src, real", [
    ("Counts the set bits.", BODY, True), ("/** @brief */", BODY, False), ("/// f", BODY, False), (None, "/* Waits until the bus is idle. */\n" + BODY, True),
    (None, BODY, False), ("TODO: split this. Counts the set bits.", BODY, True), ("see above", BODY, False), ("/* Copyright (c) 2020 X. All rights reserved. */", BODY, False),
    ("@author gk", BODY, False), ("Created by gk", BODY, False), ("Created lazily on first use.", BODY, True), ("int f(int mask)", BODY, False), ("/** @param mask mask */", BODY, False),
    ("// ------", BODY, False), ("Real words here.", "int f(int x);", False), ("Real words here.", "int f(int x) = delete;", False), ("Real words here.", 'int f(char *s = "{}");', False),
    ("Real words here.", "int f(void) { return '}'; ", False), ("Real words here.", "A::A(int b) : x{b}, y(2) { run(\"}\"); }", True), ("Real words here.", "int f(struct s a = {1, 2}) ;", False),
    ("Real words here.", "int t[2] = {1, 2};", False), ("   ", "int f(void)\r\n{\r\n /* Real words inside. */\r\n}", False), ("Wartet auf den Bus.", BODY, True), ("", "", False), ("漏電検出ブロックを初期化する。", BODY, True),
])
def test_documentation_is_real(spark, doc, src, real):
    cut = docpairs._named(list(docpairs.functions(src)), "f")
    got = bool(cut) and bool(docpairs.describe(doc, "f " + cut.declaration) or docpairs.describe(cut.comment, "f " + cut.declaration))
    assert got == real


FILE = """/* Licence: do as you like. */

#include <a.h>
#define TWICE(x) { x; x; }

/* A note about the whole file. */

// Waits until the bus
// is idle.
static int wait_idle(int tries)
{
    return tries ? wait_idle(tries - 1) : 0; /* } */
}

int plain(void) { return 1; }   // speaks of the line before
int next(void) { return 2; }

/** Cut off by a blank line. */

int cut(void) { return 3; }
int table[2] = { 1, 2 };  struct point p = { .x = f(1) };

namespace hal {
/// Keeps the ring of samples.
class Ring {
public:
    /** Builds an empty ring of that many places. */
    explicit Ring(int n) : size{n}, data(new int[n]) { clear(); }
    Ring &operator=(const Ring &r) = default;
    /// Compares two rings place by place.
    bool operator==(const Ring &r) const { return true; }
private:
    int size{0};
};
}
/* Never closed. */
int open(void) {
"""


def test_functions_of_a_whole_file(spark):
    """Every function is found, with the comment that touches it and no other; the second function doesn't take the first one's."""
    got = {f.declaration.split("(")[0].split()[-1].lstrip("&"): f.comment for f in docpairs.functions(FILE.replace("/* Never closed. */\nint open(void) {\n", ""))}
    assert list(got) == ["wait_idle", "plain", "next", "cut", "Ring", "operator=="]
    assert got["wait_idle"].split() == "// Waits until the bus // is idle.".split() and got["plain"] == got["next"] == got["cut"] == ""
    assert "empty ring" in got["Ring"] and "place by place" in got["operator=="]
    bodies = {f.declaration: f.body for f in docpairs.functions("/* First one. */\nint a(int x) { return 1; }\n/* Second one. */\nint b(int x) { return 2; }")}
    assert bodies == {"int a(int x)": "{ return 1; }", "int b(int x)": "{ return 2; }"}
    rows = docpairs.file_pairs(spark.createDataFrame([(1, FILE), (2, None), (3, "")], "key string, text string"), "key", "text").orderBy("place").collect()
    assert [(r["key"], r["place"]) for r in rows] == [("1", 0), ("1", 4), ("1", 5)]


@pytest.mark.parametrize("doc, own, real", [
    ("Idempotent.", "set_mask int set_mask(int mask)", True), ("Interrupt safe.", "int f(int interval)", True), ("Sets the masks.", "set_mask int set_mask(int mask)", False),
    ("SetMask()", "set_mask", False), ("Spinning lock.", "spi int spi(void)", True), ("Réentrant.", "f", True), ("Stopped timers", "stop_timer", False), ("Lorem dolor.", "f", True),
    ("Same as above.", "f", False), ("Nur ein Platzhalter für den Bus.", "f", True), ("@todo", "f", False), ("Beschreibung folgt", "f", False), ("@copydoc g", "f", False), ("Documented in the manual.", "f", False),
])
def test_one_word_of_its_own_is_enough(doc, own, real):
    """Held-out wordings: a word that isn't a form of the declaration's words is documentation."""
    assert bool(docpairs.describe(doc, own)) == real


def test_pairs_of_rows(spark):
    texts = spark.createDataFrame([
        (1, "f", None, None, "Counts the set bits.", BODY, 0), (1, "f", None, None, "Counts the set bits.", BODY, 0), (2, None, None, None, None, None, 0), (None, "f", "f", "f", "Real words here.", BODY, 0),
        (3, "f", "f", "f", "Real words here.", BODY, 0), (4, "f", "f", "f", "w " * 50_000 + "ends.", "int f(int a) {" + "x();" * 50_000 + "}", 0)],
        "symbol_id long, name string, qualified_name string, signature string, docstring string, source string, kind int")
    kinds = spark.createDataFrame([(1, "function"), (3, "field"), (4, "method"), (4, "method"), (None, "function"), (9, None)], "id long, kind string")
    got = docpairs.documented_functions(texts, kinds).collect()
    assert sorted(r["symbol_id"] for r in got if r["symbol_id"]) in ([1, 1], [1, 1, 4])
    assert all(r["code"].startswith("int f") and r["description"] for r in got)
    assert docpairs.documented_functions(texts.limit(0), kinds).count() == 0


# --- 5


def vectors(rnd, n, dup):
    x = rnd.standard_normal((n, 64))
    for i in range(dup):
        x[n - 1 - i] = x[i] * rnd.uniform(0.5, 4) + rnd.standard_normal(64) * 0.12
    return x


def test_neighbours_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = vectors(rnd, 2_400, 60)
    rows = [(i, "m" if i % 3 else "k", f"h{i // 2}", [float(v) for v in x[i]], "e") for i in range(len(x))]
    bad = [(9001, "m", "b", None, ""), (9002, "m", "b", [], ""), (9003, "m", "b", [1.0] * 63, ""), (9004, "m", "b", [0.0] * 64, ""), (9005, "m", "b", [float("nan")] + [1.0] * 63, ""),
           (9006, "m", "b", [float("inf")] + [1.0] * 63, ""), (9007, None, "b", [1.0] * 64, ""), (None, "m", "b", [1.0] * 64, ""), (9008, "m", "b", [None] + [1.0] * 63, "")]
    df = spark.createDataFrame(rows + bad, "stash_id long, model string, content_hash string, embedding array<float>, nb string")
    graph = neighbours.neighbour_graph(df, block_rows=500)
    near, truth = {}, {}
    for r in graph.neighbours().collect():
        near.setdefault(r["id"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = want = 0
    for i in range(len(x)):
        s = u @ u[i]
        for j in range(len(x)):
            if rows[j][1] != rows[i][1] or rows[j][2] == rows[i][2]:
                s[j] = -2
        best = truth[i] = set(np.argsort(-s)[:10].tolist())
        hit, want = hit + len(best & near[i]), want + 10
        assert not near[i] & {9001, 9002, 9003, 9004, 9005, 9006, 9007, 9008} and len(near[i]) == 10
    assert hit / want >= 0.9
    pairs = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df, block_rows=500).collect()}
    true = {(i, j) for i in range(len(x)) for j in np.flatnonzero(u @ u[i] >= 0.9).tolist() if i < j and rows[i][1] == rows[j][1] and rows[i][2] != rows[j][2]}
    assert len(true) > 15 and pairs == true
    asked = graph.members().where("id % 50 = 0").select(F.col("id").alias("query"), "model", "h", "q")
    found = neighbours.greedy_search(graph, asked).collect()
    assert np.mean([r["id"] in near[r["query"]] for r in found]) > 0.8 and len(found) == 480
    assert np.mean([r["id"] in truth[r["query"]] for r in found]) >= 0.9


def test_descent_adds_pairs_and_a_hub_is_no_burden(spark):
    """Of few orders the descent finds what they miss; 900 copies of one vector, each of its own label, fill the lists of all."""
    rnd = np.random.default_rng(7)
    x = np.repeat(rnd.standard_normal((350, 64)), 6, axis=0)
    x = np.r_[x + rnd.standard_normal(x.shape) * 0.3, np.repeat(rnd.standard_normal((1, 64)), 900, axis=0)]
    df = spark.createDataFrame([(i, "m", f"h{i}", [float(v) for v in x[i]]) for i in range(len(x))], "stash_id long, model string, content_hash string, embedding array<float>")
    u = x[:2100] / np.linalg.norm(x[:2100], axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(u @ u.T >= 0.9, 1))}
    few, more = ({(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df, block_rows=150, orders=2, rounds=n).collect()} for n in (0, 6))
    assert len(want & few) < len(want & more)
    near = neighbours.neighbour_graph(df, block_rows=150).neighbours().groupBy("id").count().collect()
    assert len(near) == 3_000 and all(r["count"] == 10 for r in near)


def test_neighbours_of_copies_and_of_nothing(spark):
    one = [1.0] + [0.0] * 63
    rows = [(i, "m", f"h{i % 4}" if i % 5 else None, one) for i in range(12)]
    df = spark.createDataFrame(rows, "stash_id long, model string, content_hash string, embedding array<float>")
    for r in neighbours.neighbour_graph(df).neighbours().collect():
        a, b = rows[r["id"]][2], rows[r["neighbour"]][2]
        assert r["id"] != r["neighbour"] and (a is None or a != b)
    assert neighbours.similar_pairs(df.limit(0)).count() == 0
    assert neighbours.similar_pairs(df.limit(1)).count() == 0


# --- 6

ROW = ("config_hash string, usr string, id long, removed_at timestamp, is_definition int, is_weak int, is_tentative int, file_path string, signature string, docstring string, "
       "source string, seen_at timestamp, name string, qualified_name string, kind string, parent_usr string, link_name string, several string, best_id long")


def row(usr, i, removed=None, d=1, weak=0, tent=0, path="src/a.c", sig="s", doc="d", src="b", seen=1, kind="function"):
    when = datetime(2025, 1, seen) if seen else None
    return ("g", usr, i, removed, d, weak, tent, path, sig, doc, src, when, usr, usr, kind, None, usr, "x", 0)


def test_best_row_by_each_rule(spark):
    gone = datetime(2025, 1, 9)
    rows = [row("a", 1, removed=gone), row("a", 2, d=0), row("b", 3, d=0), row("b", 4), row("c", 5, weak=1), row("c", 6, tent=1), row("e", 7, path="x/A.HPP"), row("e", 8, doc=" \n"),
            row("f", 9, doc=None), row("f", 10, seen=None), row("h", 11, seen=2), row("h", 12, seen=3), row("h", 12, seen=3), row("i", 14), row("i", 13), row("j", 15), row("j", 15), row("k", 16, d=None, weak=None), row("k", 17, d=0, weak=1)]
    got = {r["usr"]: (r["several"], r["best_id"]) for r in survivors.survivors(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {"a": (True, 2), "b": (True, 4), "c": (True, 6), "e": (True, 8), "f": (True, 10), "h": (True, 12), "i": (True, 13), "j": (False, 15), "k": (True, 16)}
    bad = [("g", None, 1, *row("z", 1)[3:]), (None, "z", 1, *row("z", 1)[3:]), ("g", "z", None, *row("z", 1)[3:])]
    assert survivors.survivors(spark.createDataFrame(bad, ROW)).count() == 0


def test_reliable_sources_win_fields(spark):
    """good agrees with two others nearly always, bad never: where only good and bad disagree, good's value holds."""
    rows, i = [], 0
    for n in range(40):
        for path, doc in (("good/a.c", "true"), ("mid/a.c", "true"), ("also/a.c", "true"), ("bad/a.c", f"false{n}")):
            i += 1
            rows.append(row(f"u{n}", i, path=path, doc=doc))
    rows += [row("duel", 900, path="good/a.c", doc="true"), row("duel", 901, path="bad/a.c", doc="lie", seen=5), row("blank", 902, doc=None), row("blank", 903, doc=" ")]
    got = {r["usr"]: r for r in survivors.survivors(spark.createDataFrame(rows, ROW)).collect()}
    assert all(got[f"u{n}"]["docstring"] == "true" for n in range(40))
    assert got["duel"]["docstring"] == "true" and got["duel"]["best_id"] == 901 and got["blank"]["docstring"] is None


def test_found_reads_whole_survivors(spark, tmp_path, monkeypatch):
    """p6_found runs the rounds of truth discovery and writes every voted row, with its fields, before it lists keys."""
    rows = [row(f"u{n}", 10 * n + i, path=path, doc=doc) for n in range(9) for i, (path, doc) in enumerate((("good/a.c", "true"), ("mid/a.c", "true"), ("bad/a.c", f"false{n}")))]
    rows += [row("duel", 900, path="good/a.c", doc="true"), row("duel", 901, path="bad/a.c", doc="lie", seen=5), row("one", 902), row("one", 902)]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/symbols.parquet")
    settled, discover, apart = [], survivors.truth_discovery, tmp_path / "written"
    monkeypatch.setattr(survivors, "truth_discovery", lambda *a: settled.append(discover(*a)) or settled[-1])
    monkeypatch.setattr("quarrylens.runtime.scratch_path", lambda _, label: str(apart / f"{label}-{len(list(apart.glob('*')))}"))
    found = {r["usr"]: r["best_id"] for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert found == {**{f"u{n}": 10 * n for n in range(9)}, "duel": 901}
    (weights, rounds), (whole,) = settled[0], apart.glob("survivors-*")
    weights = {r["src"]: r["weight"] for r in weights.collect()}
    assert rounds > 1 and max(weights.values()) > 2 * min(weights.values())
    whole = {r["usr"]: r for r in spark.read.parquet(str(whole)).collect()}
    assert set(whole) == {*found, "one"} and set(survivors.FIELDS) <= set(whole["duel"].asDict()) and whole["duel"]["docstring"] == "true"


def test_one_task_settles_as_rounds_of_joins_do(spark, monkeypatch):
    draw = random.Random(6)
    claims = [(k, v, s) for k in range(300) for s in range(7) if (v := (0 if draw.random() < 0.95 - 0.1 * s else draw.randrange(1, 4))) < 3]
    df = spark.createDataFrame(claims, "k long, v long, src int")
    weights, rounds = survivors.truth_discovery(df)
    monkeypatch.setattr(survivors, "PATTERN_ROWS", 1_000)
    assert df.count() > 1_000
    monkeypatch.setattr(survivors, "_settle", None)  # not called
    joined, joins = survivors.truth_discovery(df)
    a, b = ({r["src"]: r["weight"] for r in w.collect()} for w in (weights, joined))
    assert rounds == joins > 1 and a.keys() == b.keys() and all(abs(a[s] - b[s]) < 1e-9 for s in a)
    with pytest.raises(ValueError, match="still move"):
        survivors.truth_discovery(df, max_rounds=1)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="still move"):
        survivors.truth_discovery(df, max_rounds=1)


def test_blank_texts_are_blank(spark):
    texts = ["", " ", "\t\n\x0b\f\r ", " x", "\u00a0", "\u2003\n", None, "\n\n y z "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(survivors.has_text(F.col("t"))).collect()]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(F.col("t").rlike(r"[^\s]"), F.lit(False))).collect()]
    assert got == want == [False, False, False, True, True, True, False, True]


# --- 10

CASES = [
    ("Dear {{ name }}, thank you.", True), ("Set `{{ name }}` in the header.", False), ("```\necho ${NAME}\n```\nPlain words.", False), ("> ```\n> echo ${NAME}\n> ```\nPlain words.", False),
    ("static struct a t[2] = {{0}, {1}}; keeps quiet.", False), ("Welcome to %%PROJECT_NAME%%.", True), ("Version: ____", True), ("[insert name here] is ready.", True), ("[x] done, see [1].", False),
    ("Read [The Manual](http://a.b).", False), ("| a | b |\n| 1 | 2 |", False), ("404 Not Found", True), ("Menu\nHome\n<h1>Forbidden</h1>\n© 2020 X", True), ("The server answers 404 Not Found when no asset matches.", False),
    ("Error 500 in the table above is a reading, not a status code.", False), ("Please enable JavaScript to view this page.", True), ("Our page requires JavaScript only for the plot; the rest is text.", False),
    ("Lorem ipsum dolor sit amet consectetur.", True), ("The demo scrolls lorem ipsum at 5 px per second.", False), ("Your text here.\nSample text goes here.", True), ("# Title\nReal content follows here.\n404 Not Found", False),
    ("", False), ("  \n ", False), (None, False), ("Bitte aktivieren Sie JavaScript, um fortzufahren.", True), ("Seite nicht gefunden", True), ("Copyright &company_name;, maintained by us.", True), ("a &amp; b &lt; c", False),
]


@pytest.mark.parametrize("shift", [0])
def test_residue_cases(spark, shift):
    rows = [(i, t, "r") for i, (t, _) in enumerate(CASES)] + [(None, "404 Not Found", "r"), (0, CASES[0][0], "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, reason string")
    got = {r["doc_id"] for r in residue.residue(df).collect()}
    assert [CASES[i][0] for i in range(len(CASES)) if (i in got) != CASES[i][1]] == []
    left = residue.without_residue(df)
    assert left.columns == df.columns and left.where("doc_id is null").count() == 1 and left.where("text is null").count() == 1
    assert residue.residue(df.limit(0)).count() == 0


def test_weak_fields_need_a_second_record(spark):
    one = [(1, "Report of [Board Title] for all.", "")]
    two = [*one, (2, "Report of [Chip Name] for all.", "")]
    same = [*one, (2, "Report of [Board Title] for all.", "")]
    found = lambda rows: {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert found(one) == set() and found(two) == {1, 2} and found(same) == set()


def test_long_texts_are_read_to_the_end(spark):
    text = " ".join(["Plain words of content."] * 40_000) + "\nWelcome to {{ name }}."
    assert residue.residue(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


def test_copies_of_a_text_make_no_template(spark):
    """Copies, versions and rows delivered twice of a real document stay, however often its lines come; a message repeated on different pages goes."""
    real = "# Title\nReal content follows here.\nAnd some more of it.\n404 Not Found"
    hamster = "The hamster that runs this wheel is asleep."
    found = lambda texts: {r["doc_id"] for r in residue.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found([real, real]) == set()
    assert found([real] * 30) == set()
    assert found([real, "Menu\n" + real + "\n© 2020 X", real + "\nOne line is new.", real + "\nOne line is new.\nAnd a last one."]) == set()
    assert residue.residue(spark.createDataFrame([(1, real), (1, real)], "doc_id long, text string")).count() == 0
    assert found([f"# pump.c\n404 Not Found\n{hamster}", f"# valve.c\n404 Not Found\n{hamster}"]) == {0, 1}
    assert found([f"# pump.c\n404 Not Found\n{hamster}", f"# valve.c\n404 Not Found\n{hamster}", hamster + "\nSo it says in the story."]) == set()
    assert found([f"# pump.c\n404 Not Found\n{hamster}"] * 20 + [f"# valve.c\n404 Not Found\n{hamster}"] * 20 + [hamster]) == set()
    assert residue.without_residue(spark.createDataFrame([(1, real), (2, real)], "doc_id long, text string")).count() == 2


PASSAGE = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco "
    "laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat "
    "cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)


def test_the_standard_passage_is_filler(spark):
    cases = [
        (PASSAGE, True), (PASSAGE.replace(". ", ".\n"), True), (PASSAGE.replace(", ", ",\n"), True), ("# Title\n" + PASSAGE + "\n© 2020 X", True),
        ("Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor. At vero eos et accusam et justo duo dolores et ea rebum.", True),
        ("Use lorem ipsum in mockups.", False), ("Lorem ipsum in Figma", False), ("Lorem ipsum est un faux texte.", False), (PASSAGE + " The designer put the passage in the draft.", False),
        (PASSAGE + "\nThe board has two regulators and a fuse.", False), ("The demo scrolls lorem ipsum et dolore in a box.", False), (PASSAGE + "\nsed -i", False),
    ]
    got = {r["doc_id"] for r in residue.residue(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [cases[i][0] for i in range(len(cases)) if (i in got) != cases[i][1]] == []


def test_slots_are_induced_without_a_listed_mark(spark):
    """A marked name, default or blank counts where other lines hold plain words; alone, or beside further open ones, it shows nothing."""
    line = "Welcome to the pages of {} and its crew."
    found = lambda texts: {r["doc_id"] for r in residue.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    values = ["Acme", "Blue River Labs", "#NAME#", "~name~", "Your Project Name", "______"]
    assert found([line.format(v) for v in values]) == {2, 3, 4, 5}
    assert found([line.format(v) for v in values[1:]]) == set()
    assert found([line.format(v) for v in (values[0], values[0], *values[2:])]) == set()
    two = "Dear {}, order 17 of {} is ready."
    assert found([two.format("#NAME#", "@item@"), two.format("Ada", "bolts").replace("17", "4"), two.format("Bo Li", "two nuts"), "`#NAME#` is code.", "```\n" + line.format("#NAME#") + "\n```"]) == {0}
    assert found([line.format("Acme"), line.format("Zeta"), line.format("~~Beta~~"), line.format("$n$"), line.format(":smile:")]) == set()


def found_with_evidence(spark, texts):
    return {r["doc_id"]: r["evidence"] for r in residue.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_evidence_of_the_corpus(spark):
    """What aligns or repeats says so; what stands alone is decided by its own mark."""
    line = "Welcome to the pages of {} and its crew."
    assert found_with_evidence(spark, [line.format("{{ name }}")]) == {0: "alone"}
    assert found_with_evidence(spark, [line.format("{{ name }}"), line.format("{{ owner }}")]) == {0: "aligned", 1: "aligned"}
    assert found_with_evidence(spark, [line.format("{{ name }}"), line.format("Blue River Labs")]) == {0: "aligned"}
    assert found_with_evidence(spark, [line.format("{{ name }}"), line.format("{{ name }}")]) == {0: "alone", 1: "alone"}
    assert found_with_evidence(spark, ["404 Not Found"]) == {0: "alone"}
    assert found_with_evidence(spark, ["Menu\n404 Not Found", "404 Not Found\n© 2020 X"]) == {0: "repeated", 1: "repeated"}
    gone = "Sorry, the page about {} is gone."
    assert found_with_evidence(spark, [gone.format("pumps"), gone.format("valves")]) == {0: "repeated", 1: "repeated"}


def test_pages_of_wording_in_no_list(spark):
    """Held-out wording: taught by twenty pages that have a known line too, it names pages that have none; beside content it doesn't."""
    ours, stage = "Our hamsters are fetching fresh cables.", "Stage crew, please mind the curtain."
    taught = [f"# part{i}.c\n503 Service Unavailable\n{ours}" for i in range(20)]
    got = found_with_evidence(spark, [*taught, ours, ours + "\nThe board has two regulators.", stage, stage])
    assert got == dict.fromkeys(range(21), "repeated")


def test_filler_by_its_vocabulary(spark):
    """Words learned from marked passages find a passage without the mark, none of whose words are in a list."""
    vocabulary = ["grunfel", "mopdar", "siltor", "vexan", "ploriat", "kandel", "umbrit", "tosque"]
    rnd = random.Random(3)
    passage = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + "."
    texts = ["Lorem ipsum " + passage(20) for _ in range(6)] + [passage(12), "Heading\n\nThe board has two regulators and a fuse.", passage(6) + "\nThe board draws 5 mA."]
    got = found_with_evidence(spark, texts)
    assert set(got) == {0, 1, 2, 3, 4, 5, 6} and got[6] == "repeated"


def test_one_long_line_is_a_page(spark):
    words = "<p>404 Not Found</p><p>The requested URL /a/b was not found on this server.</p>" + "<p>Please try again in a while, or write to the people who run it.</p>" * 8
    plain = words.replace("Found</p>", "Found. ").replace("<p>", "").replace("</p>", " ")
    assert found_with_evidence(spark, [words, plain, words + "<p>The board has two regulators.</p>"]).keys() == {0, 1}
