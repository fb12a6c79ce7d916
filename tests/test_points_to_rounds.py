"""Points-to with arguments: many rounds cost no more writes than one, and the results are those of a plain fix point."""

from __future__ import annotations

import pyarrow as pa

from quarrylens.operators import pointsto, solve

SOURCE = "config_hash string, slot string, function string, function_type string"
FLOW = "config_hash string, source string, target string"
SITE = "config_hash string, file string, line int, col int, ordinal int, caller string, kind string, slot string, slot_type string, callee string"
ARG = "config_hash string, file string, line int, col int, ordinal int, arg_index int, value_kind string, value string"
ESCAPE = "config_hash string, slot string, reason string"


def plain(sources, flows, sites, arguments, escapes):
    """The rounds over sets of rows of one build."""
    direct, flow, lost = {(s, f) for _, s, f, _ in sources}, {(s, t) for _, s, t in flows}, {s for _, s, _ in escapes}
    typed = {(t, f) for _, _, f, t in sources if t not in ("", "lambda")}
    while True:
        held, escaped = set(direct), set(lost)
        while True:
            more = {(t, f) for s, f in held for a, t in flow if a == s} | held
            out = {t for s in escaped for a, t in flow if a == s} | escaped
            if more == held and out == escaped:
                break
            held, escaped = more, out
        sure, guess = set(), set()
        for _, *at, _, kind, slot, slot_type, callee in sites:
            at = tuple(at)
            if kind == "address":
                continue
            mine = {f for s, f in held if s == slot}
            sure |= {(at, f) for f in (mine if slot else ())} | ({(at, callee)} if callee else set())
            if kind == "pointer" and (not slot or slot in escaped):
                guess |= {(at, f) for t, f in typed if t == slot_type and f not in mine}
        d, fl, lo = set(direct), set(flow), set(lost)
        for _, file, line, col, ordinal, index, kind, value in arguments:
            for at, f in sure:
                if at == (file, line, col, ordinal):
                    d |= {(f"P|{f}|{index}", value)} if kind == "function" else set()
                    fl |= {(value, f"P|{f}|{index}")} if kind != "function" else set()
            lo |= {f"P|{f}|{index}" for at, f in guess if at == (file, line, col, ordinal)}
        if (d, fl, lo) == (direct, flow, lost):
            return held, escaped, {(*at, f, False) for at, f in sure} | {(*at, f, True) for at, f in guess}
        direct, flow, lost = d, fl, lo


def facts():
    """Each function of a chain calls through its parameter and passes the next one on; then places with two slots, copies and escapes."""
    last = 12
    site = lambda line, caller, slot, kind="pointer", slot_type="T", callee="": ("g", "f.c", line, 1, 0, caller, kind, slot, slot_type, callee)
    sources = [("g", "V|start", "f0", "T"), ("g", "V|other", "x", "T"), ("g", "V|other", "l", "lambda"), ("g", "V|other", "f3", "U"), ("g", "P|x|1", "y", "T")]
    flows = [("g", "V|a", "V|b"), ("g", "V|b", "V|a"), ("g", "V|other", "V|a"), ("g", "V|a", "V|a"), ("g", "V|out", "V|lost")]
    sites = [site(0, "main", "V|start")] + [site(i + 1, f"f{i}", f"P|f{i}|0") for i in range(last)]
    arguments = [("g", "f.c", i, 1, 0, 0, "function", f"f{i + 1}") for i in range(last)] + [("g", "f.c", i, 1, 0, 1, "slot", "V|a") for i in range(last + 1)]
    sites += [site(50, "m", "V|a"), site(50, "m", "V|b", callee="x"), site(50, "n", "V|lost"), site(51, "m", "", slot_type="U"), site(52, "m", None, callee="f3"), site(53, "m", "V|lost", kind="member"),
              site(54, "m", "V|a", kind="address"), site(55, "m", "P|x|1", callee="y"), site(55, "m", "P|x|1", callee="y"), site(56, "m", "P|y|0")]
    arguments += [("g", "f.c", 52, 1, 0, 0, "slot", "V|start"), ("g", "f.c", 55, 1, 0, 0, "slot", "V|out"), ("g", "f.c", 99, 1, 0, 0, "slot", "V|out")]
    return sources, flows, sites, arguments, [("g", "V|out", "table")]


def test_rounds_of_arguments_in_few_writes(spark, monkeypatch):
    sources, flows, sites, arguments, escapes = facts()
    written = []
    monkeypatch.setattr(pointsto, "materialize", lambda df, label, real=pointsto.materialize: written.append(label) or real(df, label))
    other = [("h", *r[1:]) for r in sources]
    none = [(None, "V|a", "f0", "T")]
    got = pointsto.resolve_slots(spark.createDataFrame(sources + other + none, SOURCE), spark.createDataFrame(flows, FLOW), spark.createDataFrame(sites, SITE), spark.createDataFrame(arguments, ARG), escapes=spark.createDataFrame(escapes, ESCAPE))
    held, escaped, edges = plain(sources, flows, sites, arguments, escapes)
    assert ("P|f11|0", "f12") in held
    targets = [tuple(r) for r in got.targets.collect()]
    assert len(targets) == len(set(targets)) and set(targets) == {("g", *r) for r in held} | {("h", s, f) for _, s, f, _ in sources} | {(None, "V|a", "f0")}
    assert sorted(tuple(r) for r in got.escaped.collect()) == sorted(("g", s) for s in escaped)
    rows = [tuple(r)[1:] for r in got.edges.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == edges
    assert ("g", "P|f1|1", "x", "V|a") in {tuple(r) for r in got.via.collect()}
    assert len(written) < 12, written


def test_solved_rows_are_split_whole(monkeypatch):
    """Sets larger than a row or a batch come in several, with every place and function once."""
    monkeypatch.setattr(solve, "_FUNCTIONS", 3)
    monkeypatch.setattr(solve, "_EDGES", 7)
    monkeypatch.setattr(solve, "_BATCH", 10)
    rows = [("g", "source", "S", f"f{i}", None) for i in range(10)] + [("g", "type", "T", f"f{i}", None) for i in range(11)]
    rows = [(*r, None, None) for r in rows] + [("g", "site", "S", None, None, "a.c", i) for i in range(8)] + [("g", "site", "", "T", None, "b.c", i) for i in range(9)]
    columns = [pa.array(list(v), pa.int32() if i == 6 else pa.string()) for i, v in enumerate(zip(*rows))]
    batch = pa.RecordBatch.from_arrays(columns, names=[*solve.FACT, "file", "line"])
    got = [r for b in solve.solve(iter([batch.slice(0, 15), batch.slice(15)])) for r in b.to_pylist()]
    assert [(r["slot"], f) for r in got if r["part"] == "target" for f in r["functions"]] == [("S", f"f{i}") for i in range(10)]
    edges = [(r["part"] == "guess", p["file"], p["line"], f) for r in got for p in r["places"] for f in r["functions"]]
    assert sorted(edges) == sorted([(False, "a.c", i, f"f{j}") for i in range(8) for j in range(10)] + [(True, "b.c", i, f"f{j}") for i in range(9) for j in range(11)])
    assert max(len(r["functions"]) for r in got) == 3
