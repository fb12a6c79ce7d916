"""Parent-child links to full hierarchies.

Every node has at most one parent, so the links form trees, plus chains that run into a cycle. The nodes are range
partitioned, which keeps neighbours of the key order together; within a partition each chain is contracted to its
fragment exit, the first ancestor held elsewhere. The nodes that are exits of other partitions form a smaller quotient
forest, which is solved by the same steps until it fits one task; its paths then expand the fragments. A cycle becomes
local at some level and is found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import column, drop_scratch, filled, materialize

#: Nodes of a quotient forest that one task solves.
LOCAL_LIMIT = 200_000

_FRAGMENT = "g string, n string, exit string, top string, size long, low string, cyc string"


def parent_links(rows: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """One row (g, n, p) per node of a group.

    The parent is the largest filled parent among the node's rows, null if none is filled. Rows with a null group or
    a null or empty node are no nodes.
    """
    return (
        rows.select(column(group).alias("g"), column(node).alias("n"), filled(column(parent)).alias("p"))
        .where("g is not null and n is not null and n <> ''")
        .groupBy("g", "n")
        .agg(F.max("p").alias("p"))
    )


def _contract(paths: bool):
    """Contract the chains of one partition; works on nodes and on the super-nodes of a quotient alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        group, node = rows["g"].tolist(), rows["n"].tolist()
        parent = [p if isinstance(p, str) else None for p in rows["p"]]
        at = {key: i for i, key in enumerate(zip(group, node))}
        up = [-1 if p is None else at.get((g, p), -1) for g, p in zip(group, parent)]
        first = "size" not in rows
        size = [1] * len(rows) if first else rows["size"].tolist()
        low = list(node) if first else rows["low"].tolist()
        cyc = [None] * len(rows) if first else [c if isinstance(c, str) else None for c in rows["cyc"]]
        top = list(node) if first else rows["top"].tolist()
        path = None
        if paths:
            path = [[x] for x in node] if first else [list(s) for s in rows["path"]]
        leave = list(parent)
        state = bytearray(len(rows))
        for start in range(len(rows)):
            if state[start]:
                continue
            walk, i = [], start
            while state[i] == 0:
                state[i] = 1
                walk.append(i)
                if up[i] < 0:
                    break
                i = up[i]
            if up[walk[-1]] >= 0 and state[i] == 1:
                ring = walk[walk.index(i):]
                name = min(low[k] for k in ring)
                for k in ring:
                    cyc[k], leave[k], state[k] = name, None, 2
            for k in reversed(walk):
                above = up[k]
                if state[k] != 2 and above >= 0:
                    leave[k], top[k], cyc[k] = leave[above], top[above], cyc[above]
                    size[k] += size[above]
                    low[k] = min(low[k], low[above])
                    if paths and cyc[k] is None:
                        path[k] = path[above] + path[k]
                state[k] = 2
        out = {"g": group, "n": node, "exit": leave, "top": top, "size": size, "low": low, "cyc": cyc}
        if paths:
            out["path"] = [[] if c is not None else p for c, p in zip(cyc, path)]
        names = list(out)
        for a in range(0, len(rows), 20_000):
            yield pd.DataFrame({k: out[k][a : a + 20_000] for k in names})

    return run


def _mates(nodes: DataFrame, parts: int, level: int) -> DataFrame:
    """Spread super-nodes by hash, each parent whose coin shows heads together with one child whose coin shows tails.

    One child only: a parent with millions of children draws none of them into its partition. Leaves never reach the
    next quotient and of the nodes with one child a quarter is contracted, so every level shrinks by a constant factor. The
    coins are thrown anew at each level.
    """
    child = nodes.where("p is not null").groupBy("g", F.col("p").alias("n")).agg(F.min("n").alias("kid"))
    heads = lambda c: F.xxhash64(F.col("g"), c, F.lit(level)) % 2 == 0
    kids = child.select("g", F.col("kid").alias("n"), F.col("n").alias("boss"))
    placed = nodes.join(kids, ["g", "n"], "left").withColumn(
        "at", F.when(F.col("boss").isNotNull() & heads(F.col("boss")) & ~heads(F.col("n")), F.col("boss")).otherwise(F.col("n"))
    )
    return placed.drop("boss").repartition(parts, "g", "at").drop("at")


def _tasks(df: DataFrame, count: int) -> int:
    """Tasks of which none gets more nodes than it can hold."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // LOCAL_LIMIT))


def _solve(nodes: DataFrame, paths: bool, limit: int, level: int) -> DataFrame:
    """(g, n, root, size, cyc[, path]) of every node: root, nodes on the way to it, cycle, and the way itself."""
    schema = _FRAGMENT + (", path array<string>" if paths else "")
    parts = materialize(nodes.mapInPandas(_contract(paths), schema), f"fragments{level}")
    exits = parts.where("exit is not null").select("g", F.col("exit").alias("n")).distinct()
    quotient = materialize(
        parts.join(exits, ["g", "n"], "left_semi").withColumnRenamed("exit", "p"), f"quotient{level}"
    )
    count = quotient.count()
    if level > 60:
        raise RuntimeError("the quotient forest does not shrink")
    ends = parts.where("exit is null" if count else "true")
    keep = ["g", "n", F.col("top").alias("root"), "size", "cyc"] + (["path"] if paths else [])
    done = ends.select(*keep)
    if not count:
        return done
    if count <= limit:
        above = quotient.coalesce(1).mapInPandas(_contract(paths), schema).select(*keep)
    else:
        above = _solve(_mates(quotient, _tasks(quotient, count), level), paths, limit, level + 1)
    above = materialize(above, f"solved{level}")
    drop_scratch(quotient)
    up = above.select(
        "g", F.col("n").alias("exit"), F.col("root").alias("a_root"), F.col("size").alias("a_size"),
        F.col("cyc").alias("a_cyc"), *([F.col("path").alias("a_path")] if paths else []),
    )
    joined = parts.where("exit is not null").join(up, ["g", "exit"], "left")
    found = joined.select(
        "g", "n", F.coalesce("a_root", "top").alias("root"),
        (F.col("size") + F.coalesce("a_size", F.lit(0))).alias("size"), F.col("a_cyc").alias("cyc"),
        *([F.when(F.col("a_cyc").isNotNull(), F.array().cast("array<string>"))
           .otherwise(F.concat(F.coalesce("a_path", F.array().cast("array<string>")), "path")).alias("path")] if paths else []),
    )
    return done.unionByName(found)


def hierarchy(
    rows: DataFrame, group: str = "config_hash", node: str = "usr", parent: str = "parent_usr",
    paths: bool = True, local_limit: int = LOCAL_LIMIT,
) -> DataFrame:
    """Path, depth, root and cycle of every node.

    Columns: group, node, root, depth, cycle[, path]. path lists the nodes from the root down to the node, depth is 0
    at a root. A parent without rows in its group ends the chain below it: its child is a root. A node whose chain
    enters a cycle has null root and depth, an empty path, and in cycle the smallest node (byte order) of that cycle.
    Repeated rows count once; nulls see parent_links; an empty table gives an empty result; other columns are ignored.
    """
    nodes = parent_links(rows, group, node, parent)
    parts = _tasks(rows, rows.count())  # counted from the files' metadata
    solved = _solve(nodes.repartitionByRange(parts, "g", "n"), paths, local_limit, 0)
    fine = F.col("cyc").isNull()
    return solved.select(
        F.col("g").alias(group), F.col("n").alias(node), F.when(fine, F.col("root")).alias("root"),
        F.when(fine, (F.col("size") - 1).cast("int")).alias("depth"), F.col("cyc").alias("cycle"),
        *(["path"] if paths else []),
    )


def descendants(tree: DataFrame, group: str = "config_hash", node: str = "usr") -> DataFrame:
    """(group, ancestor, node, distance) for each node and each of its proper ancestors; nodes on cycles have none."""
    return tree.where("depth > 0").select(group, node, "depth", F.posexplode("path").alias("pos", "ancestor")).where(
        "pos < depth"
    ).select(group, "ancestor", node, (F.col("depth") - F.col("pos")).alias("distance"))


def cycles(tree: DataFrame) -> DataFrame:
    """The nodes whose chain of parents enters a cycle."""
    return tree.where("cycle is not null")
