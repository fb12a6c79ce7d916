"""Session, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator may hand to a broadcast without asking Spark for its size.
BROADCAST_ROWS = 20_000

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_kept: set[str] = set()


def session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrylens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python finds it wherever it runs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrylens-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/quarrylens-package.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(f"{folder}/quarrylens-package.zip")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of an index directory; Parquet, so filters and columns reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    It is the one that the cluster names in spark.checkpoint.dir. Only a local session without that setting gets a
    temporary folder of its own; a cluster without it is an error, for its machines share no temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quarrylens-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return f"file://{_own_dirs[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below this application's folder in the scratch root; the folder goes when the driver's JVM ends."""
    own = f"{scratch_root(spark)}/quarrylens-{spark.sparkContext.applicationId}-{os.getpid()}"
    if own not in _kept:
        _kept.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared scratch folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets later readers prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str):
    """A column by its plain name, dots and all."""
    return F.col(f"`{name}`")


def filled(col):
    """The column, with empty text read as null."""
    return F.when(col != F.lit(""), col)
