"""Sinks: atomic table versions, vectors, JSON export, and the project registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.merge import first_by
from quarrylens.sources.manifests import Manifests


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> None:
    """Write df as the next version of the table at path.

    A version is a folder; the newest manifest names it. Readers see the old version or the new one, at any moment one of
    them, and a writer that another one overtook gets an error. The last keep versions stay for readers under way.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    versions = Manifests(spark, f"{path}/versions")
    done = versions.read()
    data = f"data/{len(done):08d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{data}")
    if not versions.publish(len(done), {"data": data, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}):
        raise RuntimeError(f"another writer has replaced {path}")
    for old in done[: len(done) + 1 - keep]:
        _delete(spark, f"{path}/{old['data']}")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table; None before the first."""
    done = Manifests(spark, f"{path.rstrip('/')}/versions").read()
    return spark.read.schema(done[-1]["schema"]).parquet(f"{path.rstrip('/')}/{done[-1]['data']}") if done else None


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table, or a whole index, with all its versions; nothing happens if it isn't there."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_facts(facts: dict[str, DataFrame], path: str) -> None:
    """Slot facts by name, each a table partitioned by build; the builds that a table holds are replaced, the others stay."""
    for name, df in facts.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_hash").parquet(f"{path.rstrip('/')}/{name}")


def upsert_vectors(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("donor_id", "content_hash", "chunk_index"), vector: str = "embedding") -> DataFrame:
    """The stored vectors with the fresh ones in place of those of the same keys; a fresh null keeps what is stored."""
    both = stored.withColumn("__g", F.lit(1)).unionByName(fresh.where(F.col(vector).isNotNull()).withColumn("__g", F.lit(0)))
    rest = [F.col(c) for c in stored.columns if c not in (*keys, vector)]
    return first_by(both, list(keys), [F.col("__g"), *rest]).drop("__g")


def export_rows(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(kind, config_hash, json): symbols and references, these with their caller's name, one JSON object a row."""
    caller = symbols.select("config_hash", F.col("usr").alias("from_usr"), F.col("qualified_name").alias("caller"))
    s = symbols.select(F.lit("symbol").alias("kind"), "config_hash", F.to_json(F.struct("usr", "name", "qualified_name", F.col("kind").alias("symbol_kind"), "file_path", "line", "signature", "is_definition")).alias("json"))
    r = refs.join(caller, ["config_hash", "from_usr"], "left").select(F.lit("ref").alias("kind"), "config_hash", F.to_json(F.struct("to_usr", "from_usr", "caller", "from_file", "from_line", "ref_kind")).alias("json"))
    return s.unionByName(r)


def export_json(symbols: DataFrame, refs: DataFrame, path: str) -> None:
    export_rows(symbols, refs).write.partitionBy("config_hash", "kind").text(path)


def register(projects: DataFrame, fresh: DataFrame) -> DataFrame:
    """The registry with fresh rows in place of those of the same project_id."""
    both = projects.withColumn("__g", F.lit(1)).unionByName(fresh.withColumn("__g", F.lit(0)))
    return first_by(both, ["project_id"], [F.col("__g"), F.col("name"), F.col("root_path")]).drop("__g")
