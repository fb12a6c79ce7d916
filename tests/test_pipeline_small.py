"""The general problems on small tables: brute force, and the cases that the docstrings define."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import hierarchy as H
from quarrylens.operators import increment as I
from quarrylens.operators import orphans as O
from quarrylens.operators import skew as K

SYM = "config_hash string, usr string, parent_usr string, size long, top string, `a.b` string"


def forest(parents):
    """Path, root and cycle of each node by walking up."""
    out = {}
    for (g, n) in parents:
        path, at = [n], n
        while True:
            up = parents[(g, at)]
            if not up or (g, up) not in parents:
                out[g, n] = (path[-1], len(path) - 1, None, path[::-1])
                break
            if up in path:
                out[g, n] = (None, None, min(path[path.index(up):]), [])
                break
            path.append(up)
            at = up
    return out


def tree_rows(df):
    return {(r["config_hash"], r["usr"]): (r["root"], r["depth"], r["cycle"], list(r["path"])) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_equals_walking_up(spark, seed):
    rnd = random.Random(seed)
    parents = {}
    for g in "xy":
        names = [f"n{i:03d}" for i in range(60)]
        for n in names:
            parents[g, n] = rnd.choice([None, "", "gone", *names, *names]) if seed % 2 else rnd.choice([None, *[m for m in names if m < n][-3:]] or [None])
    rows = [(g, n, p, 1, "t", "z") for (g, n), p in parents.items()] + [(g, n, None, 1, "t", "z") for g, n in parents]
    df = spark.createDataFrame(rows, SYM).repartition(5)
    for limit in (5, 1_000_000):
        assert tree_rows(H.hierarchy(df, local_limit=limit)) == forest(parents)
    below = {(r[0], r[1], r[2], r[3]) for r in H.descendants(H.hierarchy(df)).collect()}
    assert below == {(g, p, n, d - i) for (g, n), (_, d, _, path) in forest(parents).items() if d for i, p in enumerate(path[:-1])}


def test_long_chain_and_ring_over_many_levels(spark):
    order = list(range(400))
    random.Random(3).shuffle(order)
    parents = {("g", f"k{order[i]:04d}"): f"k{order[i - 1]:04d}" if i else None for i in range(400)}
    parents |= {("r", f"k{order[i]:04d}"): f"k{order[i - 1]:04d}" for i in range(400)}
    df = spark.createDataFrame([(g, n, p, 0, "", "") for (g, n), p in parents.items()], SYM)
    assert tree_rows(H.hierarchy(df, local_limit=10)) == forest(parents)
    ring = H.cycles(H.hierarchy(df, paths=False, local_limit=10)).collect()
    assert len(ring) == 400 and {r["cycle"] for r in ring} == {"k0000"}


def test_hierarchy_of_nulls_own_parent_and_nothing(spark):
    rows = [(None, "a", "b", 1, "", ""), ("g", None, "b", 1, "", ""), ("g", "", None, 1, "", ""), ("g", "s", "s", 1, "", ""), ("g", "ü", "s", 1, "", "")]
    got = tree_rows(H.hierarchy(spark.createDataFrame(rows, SYM)))
    assert got == {("g", "s"): (None, None, "s", []), ("g", "ü"): (None, None, "s", [])}
    assert H.hierarchy(spark.createDataFrame([], SYM)).count() == 0


REF = "id long, config_hash string, to_usr string, from_usr string, seen_at timestamp, held string, side string, k0 string"
KEY = "config_hash string, usr string, seen_at timestamp, removed_at timestamp, state string"
T0 = datetime(2025, 1, 1)
at = lambda h: T0 + timedelta(hours=h)


def test_orphan_states(spark):
    keys = [("g", "live", at(5), None), ("g", "dead", at(1), at(9)), ("g", "dead", at(2), at(8)), ("g", "half", at(1), at(2)), ("g", "half", at(1), None), (None, "live", at(1), None), ("g", "timeless", None, None)]
    refs = [(1, "g", "live", None, at(5)), (1, "g", "live", None, at(5)), (2, "g", "live", "", at(4)), (3, "g", "dead", "none", at(9)), (4, "g", "dead", "half", at(8)),
            (5, "h", "live", None, at(6)), (6, None, "live", None, at(6)), (7, "g", "half", "dead", None), (8, "g", "Live", None, at(9)), (9, "g", "timeless", None, at(0)), (10, "g", None, None, at(1))]
    r = spark.createDataFrame([(*x, "h", "s", "k") for x in refs], REF)
    k = spark.createDataFrame([(*x, "st") for x in keys], KEY)
    got = {(x["ref_id"], x["side"], x["state"]) for x in O.orphan_references(r, k).collect()}
    assert got == {(2, "to", "late"), (3, "to", "deleted"), (3, "from", "missing"), (5, "to", "missing"), (6, "to", "missing"), (8, "to", "missing")}
    assert O.orphan_references(r.limit(0), k).count() == 0
    assert O.orphan_references(r, k.limit(0)).where("state <> 'missing'").count() == 0
    report = {(x["side"], x["state"], x["month"]): x["n_refs"] for x in O.orphan_report(O.orphan_references(r, k), "refs").collect()}
    assert report[("to", "missing", "2025-01")] == 3


def test_tree_aggregate_equals_one_aggregate(spark):
    df = spark.range(0, 3_000, 1, 40).select((F.col("id") * F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.lit(1).alias("__chunk_like"))
    hot = df.unionByName(df.withColumn("k", F.lit(3).cast("long")))
    want = {r["k"]: (r["n"], r["s"], r["m"]) for r in hot.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("m")).collect()}
    for fan in (2, 3, 100):
        got = K.tree_aggregate(hot, ["k"], {"n": ("count", F.count(F.lit(1))), "s": ("sum", F.sum("v")), "m": ("min", F.min("v"))}, fan)
        assert {r["k"]: (r["n"], r["s"], r["m"]) for r in got.collect()} == want


def test_heavy_keys_count_all_rows(spark):
    rows = [("hot", None)] * 40 + [("", "")] * 5 + [(None, "c")] + [(f"u{i}", "c") for i in range(54)]
    df = spark.createDataFrame(rows, "to_usr string, from_usr string")
    got = {(r["field_name"], r["value"], r["n"]) for r in K.heavy_keys(df, ["to_usr", "from_usr"], 0.02).collect()}
    assert got == {("to_usr", "hot", 40), ("from_usr", "c", 55)}
    assert K.heavy_keys(df.limit(0), ["to_usr"]).count() == 0
    prof = {r["usr"]: tuple(r)[1:] for r in K.usr_profile(df).collect()}
    assert prof["hot"] == (40, 0, 0, 0) and prof["c"] == (0, 0, 55, 54)


FILES = "id long, config_hash string, path string, source_hash string, flags_hash string, run_no int, seen_at timestamp, seq string"
RUNS = "config_hash string, run_no int, started_at timestamp, finished_at timestamp, state string"


def listing(rnd, files, runs):
    rows = []
    for f in range(files):
        value = "s0"
        for run in range(1, runs + 1):
            if rnd.random() < 0.3:
                value = f"s{run}"
            if rnd.random() < 0.2:
                continue
            h = rnd.choice([value] * 6 + ["", None])
            rows.append((f, "g", f"p{f}", h, "fl", run, at(run * 10 + (25 if rnd.random() < 0.1 else 1)), "x"))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    return rows


def due(rows, ok):
    last, out = {}, set()
    for f, _, _, s, g, run, _, _ in sorted(set(rows), key=lambda r: (r[0], r[5])):
        if run not in ok:
            continue
        if f not in last or not s or not g or last[f] != (s, g):
            out.add((f, run))
        last[f] = (s, g)
    return out


def test_increments_survive_failures(spark, tmp_path):
    rnd = random.Random(8)
    rows = listing(rnd, 30, 6)
    states = ["ok", "failed", "ok", "ok", "interrupted", "ok"]
    ok = {i + 1 for i, s in enumerate(states) if s == "ok"}
    runs = spark.createDataFrame([("g", i + 1, at(i * 10 + 10), at(i * 10 + 15), s) for i, s in enumerate(states)], RUNS)
    files = spark.createDataFrame(rows, FILES)
    whole = I.CommitStore(spark, f"file://{tmp_path}/whole")
    assert I.process_files(whole, files, runs)
    assert {(r["file_id"], r["run_no"]) for r in whole.committed().collect()} == due(rows, ok)
    assert not I.process_files(whole, files, runs)
    assert whole.committed().count() == len(due(rows, ok))

    # the same in steps, each of which first dies before its commit; listings that arrive in time give the same rows
    timely = [r for r in rows if r[6] == at(r[5] * 10 + 1)]
    files = spark.createDataFrame(timely, FILES)
    store = I.CommitStore(spark, f"file://{tmp_path}/steps")
    for upper in [int(x.timestamp() * 1e6) for x in (at(26), at(37), at(49), at(90))]:
        def die():
            raise OSError("lost")
        before = len(store.commits())
        with pytest.raises(OSError):
            I.process_files(store, files, runs, upper, before_commit=die)
        assert len(store.commits()) == before
        assert I.process_files(store, files, runs, upper)
    got = [(r["file_id"], r["run_no"]) for r in store.committed().collect()]
    assert sorted(got) == sorted(due(timely, ok))


def test_increments_take_late_listings(spark, tmp_path):
    rows = listing(random.Random(5), 30, 6)
    runs = spark.createDataFrame([("g", i + 1, at(i * 10 + 10), at(i * 10 + 15), "ok") for i in range(6)], RUNS)
    files = spark.createDataFrame(rows, FILES)
    store = I.CommitStore(spark, f"file://{tmp_path}/late")
    for hour in (20, 31, 47, 58, 200):
        I.process_files(store, files, runs, int(at(hour).timestamp() * 1e6))
    got = [(r["file_id"], r["run_no"]) for r in store.committed().collect()]
    assert len(got) == len(set(got)) and set(got) >= due(rows, set(range(1, 7)))


def test_increment_of_nothing(spark, tmp_path):
    store = I.CommitStore(spark, f"file://{tmp_path}/none")
    assert not I.process_files(store, spark.createDataFrame([], FILES), spark.createDataFrame([], RUNS))
    assert store.committed() is None and store.watermark() is None


def test_hot_orphan_key_is_split(spark):
    """The final plan of the join has the hot key's partition cut into parts."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
        refs = spark.range(0, 60_000, 1, 8).select("id", F.lit("g").alias("config_hash"), hot.alias("to_usr"), F.lit(None).cast("string").alias("from_usr"), F.timestamp_seconds("id").alias("seen_at"))
        keys = spark.createDataFrame([("g", "hot", at(5), None), ("g", "u1", at(5), None)], "config_hash string, usr string, seen_at timestamp, removed_at timestamp")
        found = O.orphan_references(refs, keys)
        assert found.count() == 60_000
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in names:
            spark.conf.unset(k)


def test_a_delivery_late_in_time_is_not_passed_by(spark, tmp_path):
    """A listing delivered after others were processed, with an older time than theirs, is taken; it may withdraw what was given out."""
    store = I.CommitStore(spark, f"file://{tmp_path}/store")
    row = lambda run, s, hour: (1, "g", "p", s, "fl", run, at(hour), "x")
    runs = [("g", i, at(i), at(i), "ok") for i in (1, 2, 3)]
    give = lambda name, rows, runs: I.deliver_files(store, name, spark.createDataFrame(rows, FILES), spark.createDataFrame(runs, RUNS))
    got = lambda: {(r["file_id"], r["run_no"]) for r in store.committed().collect()}
    assert give("a", [row(1, "s1", 1), row(3, "s2", 30)], runs[:1]) == 0 and I.process_news(store) and got() == {(1, 1)}
    assert not I.process_news(store)
    assert give("b", [], runs[1:]) == 1 and I.process_news(store) and got() == {(1, 1), (1, 3)}
    assert give("c", [row(2, "s2", 2)], []) == 2 and give("c", [row(2, "s9", 2)], []) == 2
    assert I.process_news(store) and got() == {(1, 1), (1, 2)} and store.watermark() == 2
    give("d", [row(2, "s2", 2)], [])
    assert I.process_news(store) and got() == {(1, 1), (1, 2)}
    with pytest.raises(RuntimeError):
        store.run(9, lambda low, high: store.committed().limit(0).withColumn("keep", F.lit(True)), before_commit=lambda: store._commits.publish(len(store.commits()), {"watermark": 9, "data": "", "schema": ""}))
