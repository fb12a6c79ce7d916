"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. Capped water-filling: a source whose share needs more than its epochs allow is
clamped at its cap, the tokens that it can't give are shared out among the others in proportion to their targets, and
so on until nothing exceeds its cap. A target whose source is left below its share, as its cap is, can't be reached. Each document then comes as often as the whole epochs of its source say, and once
more by a seeded hash for the fraction.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bpe import TOKENIZER, token_counts
from quarrylens.runtime import materialize

_PLAN = (
    "mix_id int, source string, name string, target_share double, max_repeats int, tokens long, total long, "
    "reachable boolean, mixed_tokens double, epochs double"
)


def normal_source(col):
    """Source names are equal when trimmed and lower-cased."""
    return F.lower(F.trim(col))


def source_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(name, docs, tokens) per normalized source, null for null sources; counts are combined before the shuffle."""
    return _sizes(token_counts(docs.select("source", "text"), ["source"], tokenizer=tokenizer))


def _sizes(counted: DataFrame) -> DataFrame:
    return counted.groupBy(normal_source(F.col("source")).alias("name")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")
    )


def fill(targets: list[float], caps: list[float], total: float) -> list[float]:
    """Sizes in proportion to the targets, none above its cap, that add up to total if the caps allow it."""
    out = [0.0] * len(targets)
    free = {i for i, t in enumerate(targets) if t > 0 and caps[i] > 0}
    left = total
    while free and left > 0:
        weight = sum(targets[i] for i in free)
        over = {i for i in free if targets[i] / weight * left >= caps[i]}
        for i in over or free:
            out[i] = caps[i] if over else targets[i] / weight * left
        if not over:
            break
        left -= sum(caps[i] for i in over)
        free -= over
    return out


def _plan(mix: pd.DataFrame) -> pd.DataFrame:
    mix = mix.sort_values(["name", "source", "target_share"], na_position="last").reset_index(drop=True)
    caps = [float(r) * t for r, t in zip(mix["max_repeats"], mix["tokens"])]
    total = float(mix["total"].iloc[0])
    size = fill(mix["target_share"].tolist(), caps, total)
    mix["mixed_tokens"] = size
    mix["epochs"] = [s / t if t else 0.0 for s, t in zip(size, mix["tokens"])]
    # who got less than the share, and for no other reason than the cap; the margin is for the rounding of the division
    short = [filled <= share * total * (1 + 1e-9) for filled, share in zip(size, mix["target_share"])]
    mix["reachable"] = [not (s and cap < share * total) for s, cap, share in zip(short, caps, mix["target_share"])]
    return mix


def mixing_plan(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per target: its source's tokens, the tokens of all documents, whether the target can be reached with
    max_repeats, and the size and epochs that the water-filling gives it.

    The tokens of all documents count in total, those of sources outside the mix and of null sources too. A target
    whose source has no documents has 0 tokens and can't be reached unless its share is 0. Null shares count as 0, null
    repeats as none; targets with a null mix_id are left out. Rows of a mix are as many as it names sources, a task
    takes one mix.
    """
    return plan_from_sizes(source_sizes(docs, tokenizer), targets)


def plan_from_sizes(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mixing_plan for sizes (name, tokens) that are known."""
    sizes = materialize(sizes, "source-sizes")
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    named = targets.where("mix_id is not null").select(
        "mix_id", "source", normal_source(F.col("source")).alias("name"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
    )
    joined = named.join(sizes.select("name", "tokens"), "name", "left").select(
        "mix_id", "source", "name", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.lit(total).alias("total"), F.lit(True).alias("reachable"), F.lit(0.0).alias("mixed_tokens"), F.lit(0.0).alias("epochs"),
    )
    return joined.groupBy("mix_id").applyInPandas(_plan, _PLAN)


def sample(docs: DataFrame, plan: DataFrame, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(mix_id, source, doc_id, copies and keep's columns) of each document that a mix takes; the same seed gives the same copies."""
    dose = plan.where("epochs > 0").select("mix_id", "source", "name", "epochs")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("doc_id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = F.floor("epochs") + F.when(draw < F.col("epochs") - F.floor("epochs"), 1).otherwise(0)
    taken = docs.select("doc_id", normal_source(F.col("source")).alias("name"), *keep).join(dose, "name")
    return taken.select("mix_id", F.col("source"), "doc_id", copies.cast("int").alias("copies"), *keep).where("copies > 0")


def mixing_report(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """Per target: share wanted, share planned and share really reached by the sampled copies, with epochs and cap."""
    counted = materialize(token_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"], tokenizer=tokenizer), "doc-tokens")
    plan = materialize(plan_from_sizes(_sizes(counted), targets), "mixing-plan")
    drawn = sample(counted, plan, seed, keep=("n_tokens",))
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("sampled_tokens"))
    per_mix = got.groupBy("mix_id").agg(F.sum("sampled_tokens").alias("mix_tokens"))
    planned = plan.groupBy("mix_id").agg(F.sum("mixed_tokens").alias("planned_all"))
    return (
        plan.join(got, ["mix_id", "source"], "left").join(per_mix, "mix_id", "left").join(planned, "mix_id")
        .select(
            "mix_id", "source", "target_share", F.try_divide("mixed_tokens", "planned_all").alias("planned_share"),
            F.try_divide(F.coalesce("sampled_tokens", F.lit(0)), "mix_tokens").alias("actual_share"), "tokens",
            F.coalesce("sampled_tokens", F.lit(0)).alias("sampled_tokens"), "epochs", "max_repeats", "reachable",
        )
    )
