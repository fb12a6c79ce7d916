"""Vector search, hybrid ranking and the fusion of result lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import stem_matches
from quarrylens.runtime import materialize

#: Weights of the kinds of symbols in the relevance score.
KIND_WEIGHT = {
    "function": 2, "method": 2, "constructor": 2, "destructor": 2, "class": 2, "struct": 2, "enum": 2, "typedef": 2, "enum_constant": 1,
    "namespace": 1, "varglobal": 2, "varlocal": 0, "variable": 0, "field": 0,
}
#: Groups of kinds in the order of the round robin.
KIND_GROUPS = ("function", "method", "class", "struct", "varglobal", "other")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision: null for different lengths, 0 for a zero vector."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def knn(vectors: DataFrame, query: list[float], key: str = "symbol_id", vector: str = "embedding", threshold: float | None = 0.6, limit: int | None = 30, strict: bool = False) -> DataFrame:
    """(key, distance): the nearest rows of a query vector, each key by its nearest chunk; ties go to the smaller key.

    Exact: one scan, one aggregate, and the best of each task; no limit gives all above the threshold.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = vectors.select(key, (1 - cosine(F.col(vector), q)).alias("distance")).where("distance is not null")
    if threshold is not None:
        dist = dist.where(F.col("distance") < 1 - threshold if strict else F.col("distance") <= 1 - threshold)
    best = dist.groupBy(key).agg(F.min("distance").alias("distance"))
    return best if limit is None else best.orderBy("distance", key).limit(limit)


#: Asked vectors that are sent to all tasks at once.
WAVE = 8_192


def nearest_of(asked: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, wave: int = WAVE) -> DataFrame:
    """(query, id, rank, similarity): for each asked vector the k most similar of all vectors of its length but its own; ties
    go to the smaller key. Null vectors and a null key take no part, a vector with a NaN is near nothing.

    Exact, a blocked product: the asked vectors are cut by hash into waves of about that many, which is what is sent to the
    tasks at once; every task compares its batches with the wave, and only the k best of each asked vector leave it.
    """
    spark = vectors.sparkSession
    chosen = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asks, held = materialize(chosen(asked), "asked"), chosen(vectors)
    waves = max(1, -(-asks.count() // wave))
    near = [_wave(held, asks.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).collect(), k, spark) for w in range(waves)]
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return reduce(DataFrame.unionByName, near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "rank", "similarity")


def _wave(held: DataFrame, rows: list, k: int, spark: SparkSession) -> DataFrame:
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["v"]), []).append(r)
    shared = spark.sparkContext.broadcast({n: (np.array([r["id"] for r in rs]), _unit_rows(np.array([r["v"] for r in rs], "f8"))) for n, rs in by_length.items() if n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: (np.full((len(ids), k), np.iinfo("i8").max), np.full((len(ids), k), -np.inf)) for n, (ids, _) in shared.value.items()}
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for n, (asks, q) in shared.value.items():
                part = batch.filter(pa.array(size == n))
                for at in range(0, part.num_rows, 4_096):
                    ids = part.column(0).slice(at, 4_096).to_numpy(zero_copy_only=False)
                    x = part.column(1).slice(at, 4_096).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(ids), n)
                    sims = np.round(q @ _unit_rows(x).T, 9)
                    sims[(asks[:, None] == ids[None, :]) | np.isnan(sims)] = -np.inf
                    names, sims = np.concatenate([best[n][0], np.broadcast_to(ids, sims.shape)], 1), np.concatenate([best[n][1], sims], 1)
                    order = np.lexsort((names, -sims), axis=1)[:, :k]
                    best[n] = np.take_along_axis(names, order, 1), np.take_along_axis(sims, order, 1)
        for n, (names, sims) in best.items():
            row, place = np.nonzero(np.isfinite(sims))
            asks = shared.value[n][0]
            yield pa.RecordBatch.from_arrays([pa.array(asks[row]), pa.array(names[row, place]), pa.array(sims[row, place])], ["query", "id", "similarity"])

    return held.mapInArrow(run, "query long, id long, similarity double")


def _unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def knn_all(vectors: DataFrame, query: list[float], key: str = "symbol_id", vector: str = "embedding", threshold: float = 0.6, cap: int = 4_096) -> tuple[DataFrame, bool]:
    """All rows above a threshold, the nearest cap of them, and whether there are more."""
    near = materialize(knn(vectors, query, key, vector, threshold, limit=cap + 1, strict=True), "near")
    return near.orderBy("distance", key).limit(cap), near.count() > cap


def hybrid_rerank(candidates: DataFrame, vectors: DataFrame, query: list[float], key: str = "symbol_id") -> DataFrame:
    """Text candidates that have a vector, by distance."""
    return knn(vectors.join(candidates.select(key).distinct(), key, "left_semi"), query, key, threshold=None, limit=None)


def source_boost(hits: DataFrame, by: list[str], project: float = 1.2, other: float = 0.85, window: int = 200, key: str = "symbol_id", first: int = 1_000) -> DataFrame:
    """hits (by, key, similarity, is_project) with boosted similarity, per query (by) reordered only inside windows of
    raw ranks; adds rank. The result is the first places of each query, in whole windows; every task keeps as many only."""
    places = -(-first // window) * window
    raw = hits.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), key))).where(F.col("r") <= places)
    raw = raw.withColumn("w", F.floor((F.col("r") - 1) / window)).drop("r")
    boosted = raw.withColumn("boosted", F.col("similarity") * F.when(F.col("is_project") == 1, project).otherwise(other))
    return boosted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("w", F.desc("boosted"), key)))


def adaptive_fusion(dense: DataFrame, text: DataFrame, least: int = 3) -> tuple[DataFrame, str]:
    """The dense results if there are enough of them, else the text results."""
    return (dense, "dense") if dense.limit(least).count() >= least else (text, "text")


def relevance(rows: DataFrame, stems: list[str]) -> DataFrame:
    """rows with score: per stem 3 at a boundary of the name, else 2 in the qualified name, else 1 in the path; 1 more
    for project rows, and the weight of the kind."""
    points = [
        F.when(stem_matches(F.col("name"), s) | F.array_contains(F.split(F.coalesce("name_tokens", F.lit("")), " "), s), 3)
        .when(F.lower("qualified_name").contains(s), 2).when(F.lower("file_path").contains(s), 1).otherwise(0)
        for s in (x.lower() for x in stems) if len(s) >= 2
    ]
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv]), F.col("kind")), F.lit(0))
    return rows.withColumn("score", reduce(lambda a, b: a + b, points, F.lit(0)) + F.when(F.col("is_project") == 1, 1).otherwise(0) + kind)


def deduplicate(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per query (by), name and file_path: at the place of the first one seen, with the content of the first
    definition; adds place, a struct that sorts like order."""
    whole = [*by, "name", "file_path"]
    seen = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = F.struct(*[c for c in rows.columns if c not in whole])
    best = rows.groupBy(*whole).agg(F.min(seen).alias("place"), F.min_by(rest, F.struct((-F.col("is_definition")).alias("d"), seen.alias("s"))).alias("r"))
    return best.select(*whole, "r.*", "place")


def round_robin_kinds(rows: DataFrame, by: list[str], order: list[Column], limit: int = 20) -> DataFrame:
    """The first of each group of kinds, then the second, up to limit per by; unknown kinds are other."""
    group = F.when(F.col("kind").isin(*KIND_GROUPS[:-1]), F.col("kind")).otherwise("other")
    pos = F.array_position(F.array(*[F.lit(k) for k in KIND_GROUPS]), group)
    turn = rows.withColumn("pos", pos).withColumn("turn", F.row_number().over(Window.partitionBy(*by, "pos").orderBy(*order)))
    return turn.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "pos"))).where(F.col("rank") <= limit)


def merge_lists(lists: DataFrame, by: list[str], key: str, limit: int = 1_000) -> DataFrame:
    """Lists (by, term_pos, rank, key) interleaved by rank per query (by), each key at its first occurrence; adds place. The
    first limit places of each query; every task keeps as many only."""
    first = lists.groupBy(*by, key).agg(F.min(F.struct("rank", "term_pos")).alias("f"))
    placed = first.select(*by, key, "f.rank", "f.term_pos", F.row_number().over(Window.partitionBy(*by).orderBy("f.rank", "f.term_pos", key)).alias("place"))
    return placed.where(F.col("place") <= limit)


def reuse_vectors(wanted: DataFrame, stash: DataFrame) -> DataFrame:
    """(content_hash, model, donor_id): donors whose chunks 0 .. n are all there; of several the lowest."""
    whole = stash.where("embedding is not null").groupBy("model", "content_hash", "donor_id").agg(F.max("chunk_index").alias("last"), F.countDistinct("chunk_index").alias("n")).where("last + 1 = n")
    return wanted.select("content_hash").distinct().join(whole, "content_hash").groupBy("content_hash", "model").agg(F.min("donor_id").alias("donor_id"))


def orphan_vectors(vectors: DataFrame, symbols: DataFrame, key: str = "symbol_id") -> DataFrame:
    return vectors.join(symbols.select(F.col("id").alias(key)), key, "left_anti")


def hard_negatives(dense: DataFrame, text: DataFrame, k: int = 10, least: int = 3, seed: int = 42) -> DataFrame:
    """(query, dense_id, text_id): one id that only the dense top k has and one that only the text's has.

    dense and text: query, rank, id. Queries with fewer than least results on a side are left out; the pick is the
    smallest seeded hash, so it is the same each time.
    """
    a, b = (df.where((F.col("rank") <= k) & (F.col("id") != F.col("query"))) for df in (dense, text))
    enough = a.groupBy("query").count().where(F.col("count") >= least).select("query").join(b.groupBy("query").count().where(F.col("count") >= least).select("query"), "query")
    pick = lambda x, y, n: x.join(y, ["query", "id"], "left_anti").groupBy("query").agg(F.min_by("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))).alias(n))
    return enough.join(pick(a, b, "dense_id"), "query").join(pick(b, a, "text_id"), "query")


#: The templates of made-up queries with their weights.
QUERY_TEMPLATES = (
    ("function that {summary}", 0.35),
    ("code for {kind} {name}", 0.25),
    ("{summary}", 0.20),
    ("implementation of {name}", 0.10),
    ("{kind} {name} usage", 0.05),
    ("{docstring}", 0.05),
)


def made_queries(rows: DataFrame, key: str, least: int = 8, width: int = 120) -> DataFrame:
    """(key, query): one query for each row that has a summary or a docstring, from its name, kind, summary and docstring.

    The template is drawn by the weights from a hash of the key. Summary and docstring are stripped and cut; what is
    shorter than least without its blanks and last full stops is no query.
    """
    blank = lambda c: F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    text = lambda c: F.substring(blank(F.coalesce(c, F.lit(""))), 1, width)
    value = {"summary": text(F.col("summary")), "docstring": text(F.col("docstring")), "name": F.coalesce("name", F.lit("")), "kind": F.coalesce("kind", F.lit(""))}
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    made, upto = None, 0
    for template, weight in QUERY_TEMPLATES:
        upto += round(100 * weight)
        parts = [value[field] if field else F.lit(words) for words, field in _fields(template)]
        made = (F if made is None else made).when(draw < upto, F.concat(*parts))
    query = F.regexp_replace(blank(made), r"\.+$", "")
    kept = rows.where((value["summary"] != "") | (value["docstring"] != ""))
    return kept.select(key, query.alias("query")).where(F.length("query") >= least)


def _fields(template: str) -> list[tuple[str, str]]:
    """The pieces of a template: (words, '') or ('', field)."""
    out = []
    for i, piece in enumerate(re.split(r"[{}]", template)):
        if piece:
            out.append(("", piece) if i % 2 else (piece, ""))
    return out


def cut_body(source: str, width: int) -> list[str]:
    """Pieces of at most width characters, cut after the best line end that fits: a closing brace, a semicolon, a blank
    line, any line; of equals the last. A longer line is cut hard."""
    if len(source) <= width:
        return [source]
    lines, out, at = source.split("\n"), [], 0
    worth = [1 if t.endswith("}") else 2 if t.endswith(";") else 4 if t else 3 for t in (x.rstrip() for x in lines)]
    while at < len(lines):
        end, used = at, 0
        while end < len(lines) and (end == at or used + len(lines[end]) + 1 <= width):
            used += len(lines[end]) + 1
            end += 1
        if end < len(lines):
            best = min(worth[at:end])
            end = max(i for i in range(at, end) if worth[i] == best) + 1
        piece = "\n".join(lines[at:end])
        out += [piece[i : i + width] for i in range(0, len(piece), width)]
        at = end
    return out or [source]


def chunk_bodies(rows: DataFrame, key: str, text: str, width: int = 1500) -> DataFrame:
    """(key, chunk_index, chunk) of every text, Arrow batches through Python."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [(k, i, c) for k, t in zip(b[key], b[text]) for i, c in enumerate(cut_body(t, width))]
            yield pd.DataFrame(cut, columns=[key, "chunk_index", "chunk"])

    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_index int, chunk string")


def rerank(rows: DataFrame, text: str, score, limit: int) -> DataFrame:
    """rows by a model's score: a pandas UDF that the caller brings."""
    return rows.withColumn("rerank", score(F.col(text))).orderBy(F.desc("rerank")).limit(limit)
