"""Processing only new or changed records.

A store numbers what it is given: every delivery of records is written to a folder of its own and gets the next number
of a log when it is complete. That number, not a time in the records, is the commit sequence: a record delivered late
has a higher number than all that was processed before, so no increment can pass it by. A run fixes its upper number at
its start, takes the deliveries above the watermark and not above that limit (their folders are all it lists), writes its
output to a folder of its own, and commits output and watermark together in one manifest. A run that fails before that
leaves only a folder that no manifest names; the next one starts from the same watermark. Manifests are put into place by
an operation that fails if the name is taken (a hard link on a local or mounted file system, a rename without overwriting
elsewhere), so of two runs that race for a number one gets an error. Object stores without an atomic rename are not fit
for the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.runtime import filled
from quarrylens.sources.manifests import Manifests

#: Folders into which deliveries and outputs are cut by the hash of their build, so that a run reads those that it touches.
PARTS = 32


class CommitStore:
    """Deliveries, outputs and watermarks of a pipeline under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._log, self._commits = (Manifests(spark, f"{self.path}/{kind}") for kind in ("log", "commits"))

    # --- what came in

    def deliveries(self) -> list[dict]:
        """The manifests of the log in order."""
        return self._log.read()

    def deliver(self, name: str, tables: dict[str, DataFrame], parts: str = "config_hash") -> int:
        """Write a delivery of tables and give it the next number; one of that name which is already there keeps its number.

        The name makes a repeated call harmless: a stream's batch number, a file's name. Rows are cut into folders by the
        hash of the column parts; adaptive execution splits those that grow large.
        """
        for d in self.deliveries():
            if d["name"] == name:
                return d["number"]
        folder = f"in/__delivery={uuid.uuid4().hex[:12]}"
        held = {}
        for table, df in tables.items():
            cut = df.withColumn("__part", F.pmod(F.xxhash64(parts), F.lit(PARTS)).cast("int")).hint("rebalance", "__part")
            cut.write.option("compression", "zstd").partitionBy("__part").parquet(f"{self.path}/{folder}/__table={table}")
            held[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        while True:
            done = self.deliveries()
            for d in done:
                if d["name"] == name:
                    return d["number"]
            if self._log.publish(len(done), {"number": len(done), "name": name, "data": folder, "tables": held}):
                return len(done)

    def delivered(self, table: str, above: int | None, upto: int | None, parts: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of a table in the deliveries with above < number <= upto, of those parts; None without a delivery."""
        chosen = [d for d in self.deliveries() if (above is None or d["number"] > above) and (upto is None or d["number"] <= upto) and table in d["tables"]]
        return self._read("in", [f"{d['data']}/__table={table}" for d in chosen], chosen[0]["tables"][table] if chosen else "", ("__delivery", "__table"), parts)

    def _read(self, root: str, folders: list[str], schema: str, names: tuple[str, ...], parts: Iterable[int] | None) -> DataFrame | None:
        """One scan of folders below root, however many; names are the parts of their paths."""
        if not folders:
            return None
        shape = ", ".join([schema, *(f"`{n}` string" for n in names), "`__part` int"])
        df = self.spark.read.schema(shape).option("basePath", f"{self.path}/{root}").parquet(*[f"{self.path}/{f}" for f in folders])
        return (df if parts is None else df.where(F.col("__part").isin(*parts) if parts else F.lit(False))).drop("__part", *names)

    # --- what went out

    def commits(self) -> list[dict]:
        """The manifests of the commits in order."""
        return self._commits.read()

    def watermark(self) -> int | None:
        done = self.commits()
        return done[-1]["watermark"] if done else None

    def committed(self, parts: Iterable[int] | None = None) -> DataFrame | None:
        """What holds after all commits: a row is withdrawn by a later one with keep false; None before the first commit."""
        done = self.commits()
        if not done:
            return None
        rows = self._read("out", [c["data"] for c in done], done[0]["schema"], ("__run",), parts)
        if len(done) > 1:
            keys = [c for c in rows.columns if c not in ("keep", "commit")]
            rows = rows.groupBy(*keys).agg(F.max_by("keep", "commit").alias("keep"))
        return rows.where("keep").drop("keep", "commit")

    def snapshot(self) -> DataFrame | None:
        """The rows of the last commit alone, for runs whose output stands for all that came before."""
        done = self.commits()
        return self._read("out", [done[-1]["data"]], done[-1]["schema"], ("__run",), None).where("keep").drop("keep", "commit") if done else None

    def run(self, upper: int | None, make: Callable[[int | None, int], DataFrame], before_commit: Callable[[], None] | None = None, parts: str = "config_hash") -> bool:
        """Process (watermark, upper] once; True if something was committed.

        make gets watermark and limit and returns the run's output, rows with a flag keep. before_commit is a hook for
        tests of failures.
        """
        done = self.commits()
        low = done[-1]["watermark"] if done else None
        if upper is None or (low is not None and upper <= low):
            return False
        number = len(done)
        data = f"out/__run={number:08d}-{uuid.uuid4().hex[:12]}"
        out = make(low, upper).withColumn("commit", F.lit(number))
        cut = out.withColumn("__part", F.pmod(F.xxhash64(parts), F.lit(PARTS)).cast("int")).hint("rebalance", "__part")
        cut.write.option("compression", "zstd").partitionBy("__part").parquet(f"{self.path}/{data}")
        if before_commit:
            before_commit()
        manifest = {"watermark": upper, "data": data, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)}
        if not self._commits.publish(number, manifest):
            raise RuntimeError(f"another run committed number {number}")
        return True


_KEY = ["config_hash", "file_id", "run_no"]


def listings(files: DataFrame) -> DataFrame:
    """(config_hash, file_id, run_no, source_hash, flags_hash, seen_at) of rows of files; null ids, builds and runs are no listings."""
    return files.where("id is not null and config_hash is not null and run_no is not null").select(
        "config_hash", F.col("id").alias("file_id"), "run_no", "source_hash", "flags_hash", "seen_at"
    )


def ended(runs: DataFrame) -> DataFrame:
    """(config_hash, run_no, ok, ended_at) of rows of runs."""
    return runs.where("config_hash is not null and run_no is not null").select(
        "config_hash", "run_no", F.coalesce(F.col("state") == "ok", F.lit(False)).alias("ok"), F.coalesce("finished_at", "started_at").alias("ended_at")
    )


def changed_listings(known: DataFrame) -> DataFrame:
    """The listings that differ from the last earlier one of their file; a null or empty hash equals nothing."""
    order = Window.partitionBy("config_hash", "file_id").orderBy("run_no")
    now = F.struct("source_hash", "flags_hash")
    same = F.lit(True)
    for c in ("source_hash", "flags_hash"):
        same &= F.coalesce(filled(F.col(c)) == filled(F.col(f"last.{c}")), F.lit(False))
    return known.withColumn("last", F.lag(now).over(order)).where(~same).drop("last")


def deliver_files(store: CommitStore, name: str, files: DataFrame, runs: DataFrame) -> int:
    """One delivery of rows of files and runs."""
    return store.deliver(name, {"files": listings(files), "runs": ended(runs)})


def deliver_news(store: CommitStore, files: DataFrame, runs: DataFrame, upper: int | None = None) -> None:
    """Deliver what a growing table holds and the log doesn't, for sources that can't name their deliveries.

    The whole of both tables is compared with the log by the hashes of their rows. upper, microseconds, leaves out what
    had not arrived by then.
    """
    tables = {"files": listings(files), "runs": ended(runs)}
    fresh = {}
    for (table, df), when in zip(tables.items(), ("seen_at", "ended_at")):
        if upper is not None:
            df = df.where(F.coalesce(F.unix_micros(when), F.lit(0)) <= upper)
        have = store.delivered(table, None, None)
        df = df.distinct()
        if have is not None:
            row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]).alias("__row")
            df = df.withColumn("__row", row).join(have.select(row).distinct(), "__row", "left_anti").drop("__row")
        fresh[table] = df
    if any(not df.isEmpty() for df in fresh.values()):
        store.deliver(f"news-{uuid.uuid4().hex}", fresh)


def process_news(store: CommitStore, before_commit: Callable[[], None] | None = None) -> bool:
    """One incremental run over the deliveries since the watermark, up to the last one that is there now.

    The output is (config_hash, file_id, run_no) of each listing of a run that ended well whose hashes differ from the
    file's last earlier one. Only files with a new listing, or one whose run has ended since, are looked at, in the parts of the
    log that hold their builds. What was given out before isn't repeated; a late listing may also withdraw what was
    given out, as the file's last earlier listing is another one then. Rows delivered twice give one; of rows that
    differ the one seen last holds.
    """
    log = store.deliveries()

    def make(low: int | None, high: int) -> DataFrame:
        ok = store.delivered("runs", None, high).groupBy("config_hash", "run_no").agg(F.bool_or("ok").alias("ok")).where("ok").drop("ok")
        touched = parts = None
        if low is not None:
            new, over = store.delivered("files", low, high), store.delivered("runs", low, high).where("ok").select("config_hash", "run_no").distinct()
            part = F.pmod(F.xxhash64("config_hash"), F.lit(PARTS)).cast("int").alias("p")
            parts = [r[0] for r in new.select(part).union(over.select(part)).distinct().collect()]  # PARTS at most
            waiting = store.delivered("files", None, low, parts).join(over, ["config_hash", "run_no"], "left_semi")
            touched = new.select("config_hash", "file_id").union(waiting.select("config_hash", "file_id")).distinct()
        rows = store.delivered("files", None, high, parts)
        if touched is not None:
            rows = rows.join(touched, ["config_hash", "file_id"], "left_semi")
        latest = rows.groupBy(*_KEY).agg(F.max(F.struct("seen_at", "source_hash", "flags_hash")).alias("last"))
        known = latest.join(ok, ["config_hash", "run_no"]).select(*_KEY, "last.source_hash", "last.flags_hash")
        now = changed_listings(known).select(*_KEY)
        before = store.committed(parts) if low is not None else None
        if before is None:
            return now.withColumn("keep", F.lit(True))
        before = before.join(touched, ["config_hash", "file_id"], "left_semi").withColumn("was", F.lit(True))
        both = now.withColumn("keep", F.lit(True)).join(before, _KEY, "full")
        return both.where("keep is null or was is null").select(*_KEY, F.coalesce("keep", F.lit(False)).alias("keep"))

    return store.run(log[-1]["number"] if log else None, make, before_commit)


def process_files(store: CommitStore, files: DataFrame, runs: DataFrame, upper: int | None = None, before_commit=None) -> bool:
    """deliver_news, then process_news."""
    deliver_news(store, files, runs, upper)
    return process_news(store, before_commit)
