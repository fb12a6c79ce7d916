"""Best representative of each duplicate group.

Iterative truth discovery: where the rows of a group disagree on a field, every source votes for the values that it
claims with a weight drawn from its reliability; the reliability of a source is the support that its claims found;
both are estimated in turn until the weights stand still. Each field of the survivor then takes its highest-supported
value. Values travel as 64-bit hashes beside the id of the best row that holds them; the texts are fetched once, by id,
for the values that won. The survivor's id follows an order that the rows state themselves (not removed, definition,
strong, real, not a header, complete, recent), which no vote can change; its fields are what the votes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import drop_scratch, materialize

#: Fields whose values are put to the vote.
FIELDS = ("name", "qualified_name", "kind", "signature", "docstring", "parent_usr", "link_name", "source", "file_path")
#: The estimate ends when no weight moved by more than TOLERANCE; one that hasn't after MAX_ROUNDS is an error.
TOLERANCE, MAX_ROUNDS = 0.01, 50
#: Claims of patterns in one task of a round; so few in all are settled by one task.
PATTERN_ROWS = 400_000
SPACE = " \t\n\x0b\f\r"


def has_text(col: Column) -> Column:
    return F.coalesce(F.ltrim(col, F.lit(SPACE)) != "", F.lit(False))  # ends at the first mark, a pattern decodes the whole text


def same_path(col: Column) -> Column:
    """One spelling of a path: slashes, no ./ and no doubled slashes."""
    mended = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"\\", "/"), r"/+", "/"), r"(^|/)(\./)+", "$1")
    return F.when(col.contains("\\") | col.contains("//") | col.contains("./"), mended).otherwise(col)  # few need it


def source_of(rows: DataFrame) -> Column:
    """The source that a row speaks for: top folder, file extension, and whether it is a definition."""
    path = same_path(F.coalesce("file_path", F.lit("")))
    return F.concat_ws("|", F.lower(F.regexp_extract(path, "^/?([^/]*)/", 1)), F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)), F.coalesce("is_definition", F.lit(0)))


def _claim(field: str) -> Column:
    value = same_path(F.col(field)) if field == "file_path" else F.col(field)
    return F.when(has_text(F.col(field)), value)


def truth_discovery(claims: DataFrame, tolerance: float | None = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """(src, weight) of the sources, and the rounds taken, from claims (k, v, src): object and field, value, source.

    k and v are 64-bit hashes: these are statistics, a collision moves a weight by a hair. Every source counts once per
    value. A claim without a rival tells nothing; callers leave such claims out. Objects about which the same sources
    agree and disagree in the same way tell the same: of each such pattern one object is kept with the number of all, so
    that a round costs what there are patterns. The weights are a table, however many sources there are; Spark knows its size
    and decides how to join it. tolerance None takes max_rounds without asking.
    """
    once = materialize(claims.distinct(), "rival-claims")
    # a pattern is the set of the source sets of an object's values, as sums of hashes: no order, nothing collected
    sides = once.groupBy("k", "v").agg(F.sum(F.xxhash64("src").cast("decimal(20,0)")).alias("p"), F.count(F.lit(1)).alias("n"))
    objects = sides.groupBy("k").agg(F.sum(F.xxhash64("p", "n").cast("decimal(20,0)")).alias("p"), F.count(F.lit(1)).alias("n"))
    kept = materialize(objects.groupBy("p", "n").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("times")).select("k", "times"), "claim-patterns")
    parts = -(-once.count() // PATTERN_ROWS)  # the rounds are many and small: no more tasks than the rows ask for
    table = materialize(once.join(kept, "k").repartition(max(1, min(parts, -(-kept.count() // (PATTERN_ROWS // 8)))), "k"), "pattern-claims")
    drop_scratch(once)
    drop_scratch(kept)
    if table.count() <= PATTERN_ROWS:
        schema = f"src {table.schema['src'].dataType.simpleString()}, weight double, rounds int, moved double"
        settled = materialize(table.coalesce(1).mapInPandas(_settle(tolerance, max_rounds), schema), "source-weights")
        rounds, moved = settled.agg(F.max("rounds"), F.max("moved")).first()
        if tolerance is not None and (moved or 0.0) > tolerance:
            raise ValueError(f"weights still move by {moved:.3f} after {max_rounds} rounds")
        return settled.select("src", "weight"), rounds or 1
    weights = table.select("src").distinct().withColumn("weight", F.lit(1.0))
    for rounds in range(1, max_rounds + 1):
        both = materialize(_round(table, weights).join(weights.withColumnRenamed("weight", "was"), "src"), "source-weights")
        weights = both.select("src", "weight")
        moved = both.agg(F.max(F.abs(F.col("weight") - F.col("was")))).first()[0] or 0.0
        if tolerance is not None and moved <= tolerance or tolerance is None and rounds == max_rounds:
            return weights, rounds
    raise ValueError(f"weights still move by {moved:.3f} after {max_rounds} rounds")


def _settle(tolerance: float | None, max_rounds: int):
    """All rounds over claims that fit one task; each is that of _round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        src, names = pd.factorize(rows["src"])
        side = rows.groupby(["k", "v"], sort=False).ngroup().to_numpy()
        key = np.zeros(side.max() + 1, dtype=np.int64)
        key[side] = pd.factorize(rows["k"])[0]
        times = rows["times"].to_numpy(dtype=np.float64)
        told = np.bincount(src, times)
        weight = np.ones(len(names))
        for rounds in range(1, max_rounds + 1):
            support = np.bincount(side, weight[src])
            share = support / np.bincount(key, support)[key]
            p = (np.bincount(src, share[side] * times) + 1) / (told + 2)
            fresh = -np.log(1 - np.clip(p, 0.05, 0.95))
            fresh /= fresh.mean()
            moved, weight = float(np.abs(fresh - weight).max()), fresh
            if tolerance is not None and moved <= tolerance:
                break
        yield pd.DataFrame({"src": names, "weight": weight, "rounds": rounds, "moved": moved})

    return run


def _round(table: DataFrame, weights: DataFrame) -> DataFrame:
    """New weights: the support that each source's claims find under the old ones, as -log of what is left to doubt; 1 on average."""
    votes = table.join(weights, "src").groupBy("k", "v").agg(F.sum("weight").alias("support"))
    shares = votes.join(votes.groupBy("k").agg(F.sum("support").alias("whole")), "k").select("k", "v", (F.col("support") / F.col("whole")).alias("share"))
    score = table.join(shares, ["k", "v"]).groupBy("src").agg(((F.sum(F.col("share") * F.col("times")) + 1) / (F.sum("times") + 2)).alias("p"))
    fresh = score.select("src", (-F.log(1 - F.least(F.greatest("p", F.lit(0.05)), F.lit(0.95)))).alias("weight"))
    mean = fresh.agg(F.avg("weight").alias("mean"))
    return fresh.join(F.broadcast(mean)).select("src", (F.col("weight") / F.col("mean")).alias("weight"))  # mean is one row


def survivors(rows: DataFrame, fields: tuple[str, ...] = FIELDS, tolerance: float | None = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(config_hash, usr, several, best_id, one column per field) for each (config_hash, usr); several: two ids or more.

    best_id is the first id by: removed_at null; is_definition 1; is_weak 0; is_tentative 0; file_path not ending in
    .h, .hh, .hpp or .inc; more filled of signature, docstring and source; later seen_at; smaller id. A field has the
    value with most weight behind it, of equal ones that of the row that ranks first; null and blank texts claim
    nothing, a field without a claim is null. Flags that are null count as not set, a null seen_at as the earliest.
    Rows with null build, usr or id are left out; a row delivered twice counts once, of rows that differ under one id the
    smallest text holds. An empty table gives no rows.
    """
    used = dict.fromkeys(("config_hash", "usr", "id", "removed_at", "is_definition", "is_weak", "is_tentative", "file_path", "signature",
                          "docstring", "source", "seen_at", *fields))
    rows = rows.select(*used).where("config_hash is not null and usr is not null and id is not null")
    full = sum((has_text(F.col(c)).cast("int") for c in ("signature", "docstring", "source")), F.lit(0))
    header = F.coalesce(F.lower("file_path").rlike(r"\.(h|hh|hpp|inc)$"), F.lit(False))
    trust = F.struct(
        F.col("removed_at").isNull().alias("t1"), F.coalesce(F.col("is_definition") == 1, F.lit(False)).alias("t2"),
        (F.coalesce("is_weak", F.lit(0)) == 0).alias("t3"), (F.coalesce("is_tentative", F.lit(0)) == 0).alias("t4"),
        (~header).alias("t5"), full.alias("t6"), F.coalesce(F.unix_micros("seen_at"), F.lit(-(1 << 62))).alias("t7"), (-F.col("id")).alias("t8"),
    )
    keys = ["config_hash", "usr"]

    # one small row for each row: hashes of its values, its source, its rank
    n = range(len(fields))
    hashes = materialize(rows.select(
        *keys, F.xxhash64(*keys).alias("o"), "id", F.hash(source_of(rows)).alias("src"), trust.alias("trust"),
        *[F.when(has_text(F.col(f)), F.xxhash64(_claim(f))).alias(f"v{i}") for i, f in enumerate(fields)],
    ), "claim-hashes")
    # of each field either the one value that all rows agree on, or that it has rivals
    groups = hashes.groupBy(*keys, "o").agg(
        (F.min("id") < F.max("id")).alias("several"), (-F.max("trust")["t8"]).alias("best_id"),
        *[(F.min(f"v{i}") < F.max(f"v{i}")).alias(f"s{i}") for i in n],
        *[F.min(F.when(F.col(f"v{i}").isNotNull(), F.col("id"))).alias(f"i{i}") for i in n],  # where all agree, any row will do
    )
    groups = materialize(groups, "claim-groups")
    split = groups.where(" or ".join(f"s{i}" for i in n)).select("o", *[f"s{i}" for i in n])
    stated = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("f"), F.when(F.col(f"s{i}"), F.col(f"v{i}")).alias("v")) for i in n]), lambda c: c["v"].isNotNull()))
    rivals = materialize(hashes.join(split, "o").select("o", "src", "trust", stated.alias("c")).select(
        "o", "c.f", F.xxhash64("o", "c.f").alias("k"), "c.v", "src", "trust"), "rivals")
    weights, _ = truth_discovery(rivals.select("k", "v", "src"), tolerance, max_rounds)

    per_source = rivals.groupBy("o", "f", "v", "src").agg(F.max("trust").alias("t"))
    votes = per_source.join(weights, "src").groupBy("o", "f", "v").agg(F.round(F.sum("weight"), 9).alias("w"), F.max("t").alias("t"))
    won = votes.groupBy("o", "f").agg((-F.max(F.struct("w", "t"))["t"]["t8"]).alias("i"))
    won = won.groupBy("o").agg(*[F.max(F.when(F.col("f") == i, F.col("i"))).alias(f"w{i}") for i in n])
    # the id of the row that holds each field's value; most often one row holds all of a group
    chosen = groups.join(won, "o", "left").select(*keys, "several", "best_id", *[F.coalesce(f"w{i}", f"i{i}").alias(f"i{i}") for i in n])
    chosen = chosen.withColumn("ids", F.filter(F.array_distinct(F.array(*[f"i{i}" for i in n])), lambda i: i.isNotNull()))
    chosen = materialize(chosen, "chosen")
    twice = hashes.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*keys, F.col("id").alias("again"))
    again = materialize(twice.groupBy(*keys).agg(F.lit(True).alias("again")), "delivered-twice")
    for done in (hashes, groups, rivals):
        drop_scratch(done)
    placed = chosen.join(again, keys, "left")
    texts = rows.select(*keys, "id", *[_claim(f).alias(f"x{i}") for i, f in enumerate(fields)])
    # one row that came once: its texts are the survivor's; the others are put together from several
    one = placed.where("size(ids) = 1 and again is null").select(*keys, "several", "best_id", F.col("ids")[0].alias("id"))
    whole = one.join(texts, [*keys, "id"]).select(*keys, "several", "best_id", *[F.col(f"x{i}").alias(f) for i, f in enumerate(fields)])
    rest = placed.where("size(ids) <> 1 or again")
    parts = rest.select(*keys, F.explode("ids").alias("id"), *[f"i{i}" for i in n]).join(texts, [*keys, "id"])
    held = parts.groupBy(*keys).agg(*[F.min(F.when(F.col(f"i{i}") == F.col("id"), F.col(f"x{i}"))).alias(f) for i, f in enumerate(fields)])
    return whole.unionByName(rest.select(*keys, "several", "best_id").join(held, keys, "left"))
