"""Most similar vectors for every vector.

NN-descent. Vectors are cut into blocks by the order of a random-hyperplane code, a range partitioning that stays even
however the vectors cluster; a first graph comes from searches within the blocks of a few such orders. Then rounds of
neighbours of neighbours: every block receives, by joins, the lists that point into it and the vectors that they name,
compares all neighbours of each vector with each other, and sends the better pairs to the vectors that they concern.
The rounds end when hardly a list changes. Vectors travel as 64 bytes (their direction in 8-bit steps, cosine error
about 0.001); whoever needs exact similarities compares the few chosen pairs again in full precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.runtime import BROADCAST_ROWS, drop_scratch, materialize

K, ORDERS, ROUNDS, BLOCK_ROWS, CELL_ROWS, PROBES = 10, 5, 4, 25_000, 256, 6
#: Neighbours of one vector, forward and back, that a round compares with each other (the sampling of NN-descent).
FAN = 24
#: A round that changes fewer than this share of all list places is the last.
STILL = 0.08


def _planes(dim: int, orders: int, bits: int = 30) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((dim, orders * bits)).astype("f4")


def usable_vectors(rows: DataFrame, dim: int, orders: int, ident: str, group: str, label: str, vector: str) -> DataFrame:
    """(id, model, h, q, c0 ..) of each vector of dim finite numbers that aren't all zero.

    A null label differs from every other one.
    """
    planes = _planes(dim, orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            fits = np.asarray(pa.compute.equal(pa.compute.list_value_length(lists), dim).fill_null(False))
            b = b.filter(pa.array(fits))
            if not b.num_rows:
                continue
            flat = b.column(3).flatten()
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            b, x = b.filter(pa.array(good)), x[good]
            if not len(x):
                continue
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            q = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype("i1")
            codes = (x.astype("f4") @ planes > 0).reshape(len(x), orders, -1)
            codes = (codes * (1 << np.arange(codes.shape[2])[::-1])).sum(2).astype("i4")
            raw = q.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([raw[i * dim : i * dim + dim] for i in range(len(q))], pa.binary()),
                 *[pa.array(np.ascontiguousarray(codes[:, i])) for i in range(orders)]],
                ["id", "model", "h", "q", *[f"c{i}" for i in range(orders)]],
            )

    h = F.coalesce(F.xxhash64(label), F.xxhash64(F.lit("none"), ident))
    chosen = rows.where(F.col(ident).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(ident).cast("long").alias("id"), F.xxhash64(group).alias("model"), F.when(F.col(label).isNull(), F.xxhash64(F.lit("none"), ident)).otherwise(h).alias("h"),
        F.col(vector).cast("array<float>").alias("v"),
    )
    return chosen.mapInArrow(run, "id long, model long, h long, q binary, " + ", ".join(f"c{i} int" for i in range(orders)))


def _best(sims: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, in order, with the column numbers' values; -1 and -2 fill up."""
    if sims.shape[1] > k:
        part = np.argpartition(sims, -k, axis=1)[:, -k:]
        sims, at = np.take_along_axis(sims, part, 1), part
    else:
        at = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, at = np.take_along_axis(sims, order, 1), np.take_along_axis(at, order, 1)
    ids = np.where(sims > -1.5, cols[at], -1)
    if ids.shape[1] < k:
        pad = ((0, 0), (0, k - ids.shape[1]))
        ids, sims = np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-2.0)
    return ids, sims


def block_search(x: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and similarities of the k nearest of each row among those that share a cell with it."""
    n = len(x)
    cells = max(1, n // CELL_ROWS)
    if cells > 1:
        centre = x[np.random.default_rng(n).choice(n, cells, replace=False)]
        for _ in range(2):
            home = np.argmax(x @ centre.T, 1)
            total = np.zeros_like(centre)
            np.add.at(total, home, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            centre = np.where(size > 0, total / np.maximum(size, 1e-9), centre)
        near = x @ centre.T
        homes = np.argpartition(near, -min(PROBES, cells), axis=1)[:, -min(PROBES, cells) :]
        home = np.argmax(near, 1)
    else:
        homes, home = np.zeros((n, 1), int), np.zeros(n, int)
    rows = np.repeat(np.arange(n), homes.shape[1])
    by = np.argsort(homes.ravel(), kind="stable")
    members = rows[by]
    ends = np.searchsorted(homes.ravel()[by], np.arange(cells + 1))
    own = np.argsort(home, kind="stable")
    own_ends = np.searchsorted(home[own], np.arange(cells + 1))
    ids, sims = np.full((n, k), -1, "i8"), np.full((n, k), -2, "f4")
    for c in range(cells):
        held, asks = members[ends[c] : ends[c + 1]], own[own_ends[c] : own_ends[c + 1]]
        step = max(1, 4_000_000 // max(1, len(held)))
        for a in range(0, len(asks), step):
            ask = asks[a : a + step]
            s = x[ask] @ x[held].T
            s[h[ask][:, None] == h[held][None, :]] = -2
            ids[ask], sims[ask] = _best(s, held, k)
    return ids, sims


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


#: A block of vectors, or a message to one, is packed into rows of arrays, so that Spark moves few rows of moderate size.
#: own: id, model, h, q, codes, nb, sim; ask: row; guest: row, edge's row, h, q, kth, and edges to, sim; edges: row, nb, sim.
_PACK = ("blk", "what", "src", "part", "a", "b", "c", "d", "e", "nb", "sim", "to")
_PACKED = "blk int, what string, src int, part int, a binary, b binary, c binary, d binary, e binary, nb binary, sim binary, to binary"
_SHAPE = pa.schema([("blk", pa.int32()), ("what", pa.string()), ("src", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in _PACK[4:]]])
#: Vectors and edges in one row at most: about 200 KB, which the JVM's collector still treats as a small object.
VECTORS, EDGES = 1_000, 10_000


def _pack(**arrays) -> pa.RecordBatch:
    row = {c: v.tobytes() if isinstance(v, np.ndarray) else v for c, v in arrays.items()}
    return pa.RecordBatch.from_pylist([{c: row.get(c) for c in _PACK}], _SHAPE)


def _get(row: dict, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name] or b"", kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of a partition by block."""
    by: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            by.setdefault(row["blk"], []).append(row)
    for blk in list(by):
        yield blk, by.pop(blk)


def _by_block(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("blk"))


class _Own:
    """A block's own vectors; a neighbour is its block times 2^32 plus its row there."""

    def __init__(self, rows: list[dict], k: int):
        rows = sorted((r for r in rows if r["what"] == "own"), key=lambda r: r["part"])
        all_of = lambda c, kind: np.concatenate([_get(r, c, kind) for r in rows])
        self.blk = rows[0]["blk"]
        self.ids, self.model, self.h = all_of("a", "i8"), all_of("b", "i8"), all_of("c", "i8")
        self.n = len(self.ids)
        self.q, self.codes = all_of("d", "i1").reshape(self.n, -1), all_of("e", "i4").reshape(self.n, -1)
        self.nb, self.sim = all_of("nb", "i8").reshape(self.n, k), all_of("sim", "f4").reshape(self.n, k)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.nb >= 0)
        return row, self.nb[row, place], self.sim[row, place]


def _pack_own(blk: int, moved: int, ids, model, h, q, codes, nb, sim) -> Iterator[pa.RecordBatch]:
    for part, i in enumerate(range(0, len(ids), VECTORS)):
        a, b, c, d, e, f, g = (v[i : i + VECTORS] for v in (ids, model, h, q, codes, nb, sim))
        yield _pack(blk=blk, what="own", src=0 if part else moved, part=part, a=a, b=b, c=c, d=d, e=e, nb=f, sim=g)


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _search_models(model: np.ndarray, q: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    x = _unit(q)
    at, sim = np.full((len(x), k), -1, "i8"), np.full((len(x), k), -2, "f4")
    for m in np.unique(model):
        rows = np.flatnonzero(model == m)
        found, s = block_search(x[rows], h[rows], k)
        at[rows], sim[rows] = np.where(found >= 0, rows[found], -1), s
    return at, sim


def _first_order(k: int, orders: int) -> Callable:
    """Make a partition a block, with the neighbours found within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        h, model, blk = t["h"].to_numpy(), t["model"].to_numpy(), t["blk"][0].as_py()
        q = np.frombuffer(b"".join(t["q"].to_pylist()), "i1").reshape(len(h), -1)
        at, sim = _search_models(model, q, h, k)
        codes = np.stack([t[f"c{i}"].to_numpy() for i in range(orders)], 1)
        yield from _pack_own(blk, 0, t["id"].to_numpy(), model, h, q, codes, np.where(at >= 0, (blk << 32) + at, -1), sim)

    return run


def _unfold(order: int, orders: int) -> Callable:
    """The rows (gid, model, h, q, code) of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = _get(row, "c", "i8")
                raw, dim = row["d"], len(row["d"]) // len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((row["blk"] << 32) + row["part"] * VECTORS + np.arange(len(h))), pa.array(_get(row, "b", "i8")), pa.array(h),
                     pa.array([raw[i : i + dim] for i in range(0, len(raw), dim)], pa.binary()),
                     pa.array(np.ascontiguousarray(_get(row, "e", "i4").reshape(len(h), orders)[:, order]))],
                    ["gid", "model", "h", "q", "code"],
                )

    return run


def _send(kind: str, dest: np.ndarray, src: int, **arrays) -> Iterator[pa.RecordBatch]:
    """Messages to each block in dest with its part of the arrays."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    heads, begin = np.unique(dest, return_index=True)
    for blk, a, b in zip(heads, begin, [*begin[1:], len(dest)]):
        for i in range(a, b, EDGES):
            yield _pack(blk=int(blk), what=kind, src=src, **{c: v[order[i : min(i + EDGES, b)]] for c, v in arrays.items()})


def _later_order(k: int) -> Callable:
    """Search within a partition of another order; tell each block what was found for its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        gid, h = t["gid"].to_numpy(), t["h"].to_numpy()
        q = np.frombuffer(b"".join(t["q"].to_pylist()), "i1").reshape(len(h), -1)
        at, sim = _search_models(t["model"].to_numpy(), q, h, k)
        row, place = np.nonzero(at >= 0)
        yield from _send("edges", gid[row] >> 32, -1, a=(gid[row] & 0xFFFFFFFF).astype("i4"), nb=gid[at[row, place]], sim=sim[row, place])

    return run


def _merge(k: int) -> Callable:
    """Put the edges that a block was told into its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, rows in _blocks(batches):
            own = _Own(rows, k)
            parts = [own.edges()] + [(_get(r, "a", "i4"), _get(r, "nb", "i8"), _get(r, "sim", "f4")) for r in rows if r["what"] == "edges"]
            row, nb, sim = (np.concatenate(x) for x in zip(*parts))
            row = row.astype("i8")
            names, at = np.unique(nb, return_inverse=True)
            _, once = np.unique(row * max(1, len(names)) + at, return_index=True)
            row, nb, sim = row[once].astype("i8"), nb[once], sim[once]
            order = np.argsort(row * 4.0 - sim, kind="stable")  # by row, then falling similarity, then neighbour
            row, nb, sim = row[order], nb[order], sim[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            fits = place < k
            a, s = np.full((own.n, k), -1, "i8"), np.full((own.n, k), -2, "f4")
            a[row[fits], place[fits]], s[row[fits], place[fits]] = nb[fits], sim[fits]
            yield from _pack_own(blk, int((a != own.nb).sum()), own.ids, own.model, own.h, own.q, own.codes, a, s)

    return run


def _asks(k: int) -> Callable:
    """Each block asks the others for the vectors in its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = _Own([r], k)
                want = np.unique(own.nb[own.nb >= 0])
                want = want[want >> 32 != own.blk]
                yield from _send("ask", want >> 32, own.blk, a=(want & 0xFFFFFFFF).astype("i4"))

    return run


def _answers(k: int, fan: int) -> Callable:
    """Each block sends the vectors asked for, those of its own whose lists name the other block, and these edges.

    Of the edges to one vector the best fan go, as more of them are not compared there: a vector that all others name
    gets no more than that from any block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, rows in _blocks(batches):
            own = _Own(rows, k)
            row, nb, sim = own.edges()
            away = nb >> 32
            asked: dict[int, list[np.ndarray]] = {}
            for r in rows:
                if r["what"] == "ask":
                    asked.setdefault(r["src"], []).append(_get(r, "a", "i4"))
            order = np.lexsort((row, -sim, nb))
            row, nb, sim, away = row[order], nb[order], sim[order], away[order]
            few = np.arange(len(nb)) - np.searchsorted(nb, nb) < fan
            row, nb, sim, away = row[few], nb[few], sim[few], away[few]
            heads = sorted({*np.unique(away).tolist(), *asked} - {blk})
            kth = own.sim[:, k - 1]
            for other in heads:
                lo, hi = np.searchsorted(away, [other, other + 1])
                send = np.unique(np.concatenate([row[lo:hi].astype("i4"), *asked.get(other, [])]))
                edge = row[lo:hi].astype("i4"), (nb[lo:hi] & 0xFFFFFFFF).astype("i4"), sim[lo:hi]
                for i in range(max(-(-len(send) // VECTORS), -(-(hi - lo) // EDGES))):
                    part = send[i * VECTORS : (i + 1) * VECTORS]
                    b, to, s = (v[i * EDGES : (i + 1) * EDGES] for v in edge)
                    yield _pack(blk=int(other), what="guest", src=blk, a=part, c=own.h[part], d=own.q[part], e=kth[part], b=b, to=to, sim=s)

    return run


def _local_join(k: int, fan: int) -> Callable:
    """Compare the neighbours, forward and back, of every vector of a block with each other; send what is better than
    the last place of a list to the block of that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, rows in _blocks(batches):
            own = _Own(rows, k)
            guests = sorted((r for r in rows if r["what"] == "guest"), key=lambda r: r["src"])
            q, h, kth = [own.q], [own.h], [own.sim[:, k - 1]]
            gid = [(blk << 32) + np.arange(own.n)]
            for g in guests:
                a = _get(g, "a", "i4")
                gid.append((g["src"] << 32) + a.astype("i8"))
                q.append(_get(g, "d", "i1").reshape(len(a), own.q.shape[1]))
                h.append(_get(g, "c", "i8"))
                kth.append(_get(g, "e", "f4"))
            gid, x, h, kth = np.concatenate(gid), _unit(np.concatenate(q)), np.concatenate(h), np.concatenate(kth)
            order = np.argsort(gid)
            ranked = gid[order]

            def at(v: np.ndarray) -> np.ndarray:
                return order[np.searchsorted(ranked, v)]

            row, nb, s = own.edges()
            b = at(nb)
            inner = b < own.n
            centre, member, sim = [row, b[inner]], [b, row[inner]], [s, s[inner]]
            for g in guests:
                centre.append(_get(g, "to", "i4"))
                member.append(at((g["src"] << 32) + _get(g, "b", "i4").astype("i8")))
                sim.append(_get(g, "sim", "f4"))
            centre, member, sim = np.concatenate(centre), np.concatenate(member), np.concatenate(sim)
            by = np.lexsort((member, -sim, centre))
            centre, member = centre[by], member[by]
            once = np.r_[True, (centre[1:] != centre[:-1]) | (member[1:] != member[:-1])] if len(centre) else np.zeros(0, bool)
            centre, member = centre[once], member[once]
            place = np.arange(len(centre)) - np.searchsorted(centre, centre)
            fits = place < fan
            chosen = np.full((own.n, fan), -1, "i4")
            chosen[centre[fits], place[fits]] = member[fits]
            keys, scores, n = [], [], len(gid)
            upper = np.triu(np.ones((fan, fan), bool), 1)
            for c in range(0, own.n, 1_000):
                m = chosen[c : c + 1_000]
                v = x[m]
                v[m < 0] = 0
                g = np.matmul(v, v.transpose(0, 2, 1))
                least = np.where(m < 0, 9.0, kth[m]).astype("f4")
                i, p, r = np.nonzero(upper & (g > np.minimum(least[:, :, None], least[:, None, :])))
                u, w, g = m[i, p], m[i, r], g[i, p, r]
                good = (u >= 0) & (w >= 0)
                good[good] &= h[u[good]] != h[w[good]]
                u, w, g = u[good].astype("i8"), w[good].astype("i8"), g[good]
                key, first = np.unique(np.minimum(u, w) * n + np.maximum(u, w), return_index=True)
                keys.append(key)
                scores.append(g[first])
            key, first = np.unique(np.concatenate(keys), return_index=True) if keys else (np.zeros(0, "i8"), np.zeros(0, int))
            score = np.concatenate(scores)[first] if keys else np.zeros(0, "f4")
            u, w = key // n, key % n
            src, dst, sc = np.r_[u, w], np.r_[w, u], np.r_[score, score]
            win = sc > kth[src]
            src, dst, sc = src[win], dst[win], sc[win]
            by = np.lexsort((-sc, src))
            src, dst, sc = src[by], dst[by], sc[by]
            fits = np.arange(len(src)) - np.searchsorted(src, src) < k
            src, dst, sc = gid[src[fits]], gid[dst[fits]], sc[fits]
            yield from _send("edges", src >> 32, blk, a=(src & 0xFFFFFFFF).astype("i4"), nb=dst, sim=sc)

    return run


def _descend(graph: DataFrame, k: int, fan: int, parts: int, label: str) -> DataFrame:
    """One round of neighbours of neighbours; src of a block is then the number of its list places that changed."""
    asks = graph.mapInArrow(_asks(k), _PACKED)
    guests = _by_block(graph.unionByName(asks), parts).mapInArrow(_answers(k, fan), _PACKED)
    better = materialize(_by_block(graph.unionByName(guests), parts).mapInArrow(_local_join(k, fan), _PACKED), f"{label}-better")
    fresh = materialize(_by_block(graph.unionByName(better), parts).mapInArrow(_merge(k), _PACKED), f"{label}-graph")
    drop_scratch(better)
    return fresh


def _resolve(k: int) -> Callable:
    """The lists of a block as edges from its ids to (block, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = _Own([r], k)
                row, place = np.nonzero(own.nb >= 0)
                for a in range(0, len(row), 50_000):
                    i, p = row[a : a + 50_000], place[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.ids[i]), pa.array(own.nb[i, p]), pa.array((p + 1).astype("i4")), pa.array(own.sim[i, p])], ["id", "gid", "rank", "similarity"]
                    )

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gid, id, model, h and q of every vector."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = _get(r, "a", "i8")
            dim = len(r["d"]) // len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array((r["blk"] << 32) + r["part"] * VECTORS + np.arange(len(ids))), pa.array(ids), pa.array(_get(r, "b", "i8")), pa.array(_get(r, "c", "i8")),
                 pa.array([r["d"][i : i + dim] for i in range(0, len(r["d"]), dim)], pa.binary())],
                ["gid", "id", "model", "h", "q"],
            )


class NeighbourGraph:
    """A finished graph in blocks."""

    def __init__(self, blocks: DataFrame, k: int):
        self.blocks, self.k = blocks, k

    def members(self) -> DataFrame:
        """(gid, id, model, h, q)."""
        return self.blocks.mapInArrow(_members, "gid long, id long, model long, h long, q binary")

    def edges(self) -> DataFrame:
        """(id, gid, rank, similarity): the lists, their entries still by block and row."""
        return self.blocks.mapInArrow(_resolve(self.k), "id long, gid long, rank int, similarity float")

    def neighbours(self, least: float = -1.0) -> DataFrame:
        """(id, neighbour, rank, similarity) of entries with at least that similarity; rank counts from 1."""
        near = self.edges().where(F.col("similarity") >= least)
        names = self.members().select("gid", F.col("id").alias("neighbour"))
        return near.join(names, "gid").select("id", "neighbour", "rank", "similarity")


@contextmanager
def _small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of a few MB: their buffers lie outside of the heap, several to a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def neighbour_graph(
    rows: DataFrame, k: int = K, dim: int = 64, ident: str = "stash_id", group: str = "model", label: str = "content_hash",
    vector: str = "embedding", orders: int = ORDERS, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS, fan: int = FAN,
) -> NeighbourGraph:
    """The graph of the k most similar vectors of each vector, of its own model and another label.

    Unusable vectors (null, of another length, with a null, NaN or infinite number, or all zero) and rows with a null
    id or model have no part in it. Ties go to the smaller block and row. An empty table gives an empty graph. There
    are at least as many blocks as the session has shuffle partitions, so that all tasks have work.
    """
    spark = rows.sparkSession
    with _small_batches(spark):
        vectors = materialize(usable_vectors(rows, dim, orders, ident, group, label, vector), "vectors")
        n = vectors.count()
        parts = max(1, min(n // 500, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // block_rows))
        first = vectors.repartitionByRange(parts, "model", "c0", "id").withColumn("blk", F.spark_partition_id())
        graph = materialize(first.mapInArrow(_first_order(k, orders), _PACKED), "order0")
        drop_scratch(vectors)
        told = []
        for i in range(1, orders):
            turn = graph.mapInArrow(_unfold(i, orders), "gid long, model long, h long, q binary, code int")
            told.append(materialize(turn.repartitionByRange(parts, "model", "code", "gid").mapInArrow(_later_order(k), _PACKED), f"order{i}"))
        if told:
            everything = graph
            for t in told:
                everything = everything.unionByName(t)
            merged = materialize(_by_block(everything, parts).mapInArrow(_merge(k), _PACKED), "graph")
            for t in [graph, *told]:
                drop_scratch(t)
            graph = merged
        for r in range(rounds if n else 0):
            fresh = _descend(graph, k, fan, parts, f"round{r}")
            drop_scratch(graph)
            graph = fresh
            if graph.agg(F.sum(F.col("src").cast("long"))).first()[0] < STILL * n * k:
                break
    return NeighbourGraph(graph, k)


def cosine(a, b):
    """Cosine of two array columns in double precision."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def similar_pairs(rows: DataFrame, threshold: float = 0.9, k: int = K, **options) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs of the graph with at least that cosine in full precision."""
    ident, vector = options.get("ident", "stash_id"), options.get("vector", "embedding")
    near = neighbour_graph(rows, k, **options).neighbours(threshold - 0.02)
    pairs = materialize(near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("i")).distinct()
    needed = rows.select(F.col(ident).cast("long").alias("i"), F.col(vector).alias("v")).join(ids, "i", "left_semi")
    needed = materialize(needed, "pair-vectors")
    full = pairs.join(needed.select(F.col("i").alias("id_a"), F.col("v").alias("va")), "id_a").join(
        needed.select(F.col("i").alias("id_b"), F.col("v").alias("vb")), "id_b"
    )
    return full.select("id_a", "id_b", cosine(F.col("va"), F.col("vb")).alias("similarity")).where(F.col("similarity") >= threshold)


def _pair_similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (_unit(np.frombuffer(b"".join(b.column(i).to_pylist()), "i1").reshape(b.num_rows, -1)) for i in (2, 3))
            sim = np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim.astype("f4"))], ["query", "id", "sim"])


def _enter(doors: list, ef: int) -> Callable:
    """The ef best entry vectors of each query (query, model, qh, qq); doors are BROADCAST_ROWS at most."""
    by: dict[int, tuple] = {}
    for model in {d["model"] for d in doors}:
        own = sorted((d for d in doors if d["model"] == model), key=lambda d: d["id"])
        by[model] = np.array([d["id"] for d in own]), np.array([d["h"] for d in own]), np.frombuffer(b"".join(bytes(d["q"]) for d in own), "i1").reshape(len(own), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = b.column(1).to_numpy()
            for model in np.unique(models):
                part = b.filter(pa.array(models == model))
                if model not in by or not part.num_rows:
                    continue
                ids, h, q = by[model]
                x, y = _unit(np.frombuffer(b"".join(part.column(3).to_pylist()), "i1").reshape(part.num_rows, -1)), _unit(q)
                for at in range(0, len(x), 2_000):
                    sims = x[at : at + 2_000] @ y.T
                    sims[part.column(2).to_numpy()[at : at + 2_000, None] == h[None, :]] = -2
                    found, s = _best(sims, ids, ef)
                    row, place = np.nonzero(s > -1.5)
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[at + row]), pa.array(found[row, place]), pa.array(s[row, place].astype("f4"))], ["query", "id", "sim"])

    return run


def greedy_search(
    graph: NeighbourGraph, queries: DataFrame, k: int = K, ef: int = 96, width: int = 16, rounds: int = 12, entries: int = 512,
) -> DataFrame:
    """(query, id, rank, similarity): the k best for each query that a greedy walk over the graph finds.

    queries has query, model, h and q as the graph's members. Every query starts from a fixed number of entry vectors of its
    model; in each round its best width candidates that were not opened yet are opened, their neighbours (both ways)
    are compared with it, and the best ef stay. Queries skip vectors of their own label h.
    """
    spread = Window.partitionBy("model").orderBy(F.xxhash64("id", F.lit(3)), "id")
    held = materialize(graph.members(), "members")
    doors = held.select("id", "model", "h", "q", F.row_number().over(spread).alias("r")).where(F.col("r") <= entries).drop("r")
    doors = materialize(doors, "doors")  # entries rows a model; written, so that Spark knows the size and chooses the join
    edges = graph.neighbours().select("id", F.col("neighbour").alias("nb"))
    edges = materialize(edges.union(edges.select(F.col("nb"), F.col("id"))).distinct(), "edges")
    asked = materialize(queries.select("query", "model", F.col("h").alias("qh"), F.col("q").alias("qq")), "asked")
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    shape = "query long, id long, sim float"
    if doors.count() <= BROADCAST_ROWS:
        start = asked.select("query", "model", "qh", "qq").mapInArrow(_enter(doors.collect(), ef), shape)
    else:
        start = asked.join(doors, "model").where("h <> qh").select("query", "id", "qq", "q").mapInArrow(_pair_similarity, shape)
    beam = materialize(start.withColumn("open", F.lit(False)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= ef).drop("r"), "beam")
    for _ in range(rounds):
        next_up = Window.partitionBy("query", "open").orderBy(F.desc("sim"), "id")
        marked = beam.withColumn("now", ~F.col("open") & (F.row_number().over(next_up) <= width))
        reached = marked.where("now").join(edges, "id").select("query", F.col("nb").alias("id")).distinct()
        new = reached.join(beam.select("query", "id"), ["query", "id"], "left_anti")
        scored = (
            new.join(held.select("id", "h", "q"), "id").join(asked, "query").where("h <> qh")
            .select("query", "id", "qq", "q").mapInArrow(_pair_similarity, shape)
        )
        both = marked.select("query", "id", "sim", (F.col("open") | F.col("now")).alias("open")).unionByName(scored.withColumn("open", F.lit(False)))
        beam = materialize(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= ef).drop("r"), "beam")
        if beam.where(~F.col("open")).isEmpty():
            break
    return beam.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "id", "rank", F.col("sim").alias("similarity"))
