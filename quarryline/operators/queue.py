"""A queue of jobs as a versioned table: who takes a job writes the next version, and of two that try one is
refused.

A version is a folder of Parquet and an entry in _log/, made by exclusive creation; a folder without an entry
is nobody's. jobs: id, kind, adapter, status (queued, running, blocked, completed, failed), created, elapsed, reason,
metrics (JSON). adapters: name, kind, ready, gpu_mb. budgets: seconds of each kind.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .intake import runnable
from .selection import dealt

SCHEMA = "id string, kind string, adapter string, status string, created double, elapsed double, reason string, metrics string"
#: Why a job waits for memory; such jobs are asked again in the next round.
NO_INVENTORY, NO_MEMORY = "GPU inventory unavailable", "GPU handoff/resource budget required"
#: The exit code of a job that wants to go on later; seconds beyond its budget that a run may take.
AGAIN, GRACE = 75, 30
#: Names of counts that a result may report, and the most that each may say.
COUNTS, MOST = ("checkpoint_step", "source_count", "proposal_count"), 1_000_000


class Conflict(RuntimeError):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Settings:
    adapters: DataFrame
    budgets: dict[str, int]
    reserve_mb: int = 512
    publish: bool = False

    def __post_init__(self):
        if not self.budgets or any(type(b) is not int or not 1 <= b <= 3600 for b in self.budgets.values()):
            raise ValueError("budgets must be 1 to 3600 whole seconds")
        if type(self.reserve_mb) is not int or self.reserve_mb < 512:
            raise ValueError("the reserve must be 512 MB at least")


@dataclass(frozen=True)
class Memory:
    """Free memory and whether unexpected residents hold some; None: the inventory could not be had."""
    free_mb: int | None
    occupied: bool = False


@dataclass(frozen=True)
class Round:
    """What claim() did: outcome (idle, busy, blocked, unresolved or running), and the job it took."""
    outcome: str
    job: dict = field(default_factory=dict)


class Queue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop
        self._log = jvm.fs.Path(f"{self.path}/_log")
        self._store = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{version:020d}.json")

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        if not self._store.exists(self._log):
            return 0
        names = [f.getPath().getName() for f in self._store.listStatus(self._log)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def _read(self, version: int) -> tuple[DataFrame, str | None]:
        """Jobs and the saved choice of a version."""
        if not version:
            return self.spark.createDataFrame([], SCHEMA), None
        entry = json.loads(self.spark.read.option("wholetext", "true").text(self._entry(version).toString()).first()[0])
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{entry['folder']}"), entry.get("next_job")

    def jobs(self) -> DataFrame:
        return self._read(self.version())[0]

    def commit(self, jobs: DataFrame, version: int, next_job: str | None = None) -> int:
        """Writes jobs as the version after `version`. If there is one already nothing is changed, and it is a Conflict."""
        folder = f"v-{uuid.uuid4().hex}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        jobs.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(at.toString())
        try:
            out = self._store.create(self._entry(version + 1), False)
        except Exception as e:
            self._store.delete(at, True)
            if not self._store.exists(self._entry(version + 1)):
                raise
            raise Conflict(f"version {version + 1} was made by another writer") from e
        out.write(bytearray(json.dumps({"folder": folder, "next_job": next_job}).encode()))
        out.close()
        return version + 1

    def submit(self, new: DataFrame) -> int:
        """Adds jobs (id, kind, adapter, created) to the queue. An id that is there already is an error."""
        version = self.version()
        jobs, choice = self._read(version)
        if new.join(jobs, "id", "left_semi").limit(1).count() or dealt(new.select("id"), new.count(), "id").groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("a job's id is taken")
        rows = new.select(F.col("id").cast("string"), "kind", "adapter", F.lit("queued").alias("status"), F.col("created").cast("double").alias("created"), F.lit(0.0).alias("elapsed"),
                          F.lit("").alias("reason"), F.lit("{}").alias("metrics"))
        return self.commit(jobs.unionByName(rows), version, choice)

    def claim(self, settings: Settings, memory: Memory) -> Round:
        """Takes the next job, if one can run: see offered(). A running job that nobody settled blocks everything, since
        it may still hold the machine."""
        version = self.version()
        jobs, choice = self._read(version)
        if jobs.where("status = 'running'").limit(1).count():
            return Round("unresolved")
        asked = offered(jobs, settings, memory)
        if not asked.where("fit is not null").limit(1).count():
            return Round("idle")
        able = asked.where("fit")
        first = able.withColumn("saved", F.col("id").eqNullSafe(F.lit(choice).cast("string"))).orderBy(F.desc("saved"), "share", "created", "id").limit(1).collect()
        taken = first[0]["id"] if first else None
        status = F.when(F.col("id").eqNullSafe(F.lit(taken).cast("string")), "running").when(F.col("fit").isNull(), F.col("status")).when(F.col("fit"), "queued").otherwise("blocked")
        new = asked.withColumn("status", status)
        try:
            self.commit(new, version, None if first else choice)
        except Conflict:
            return Round("busy")
        return Round("running", {c: first[0][c] for c in ("id", "kind", "adapter", "created", "elapsed")}) if first else Round("blocked")

    def settle(self, settings: Settings, job: str, code: int, seconds: float, next_job: str | None = None, metrics: dict | None = None, error: str | None = None) -> str:
        """Writes the end of a run: completed at exit code 0, queued again at AGAIN, else failed; blocked if it took more
        than its kind's budget and GRACE. Its time is added up. next_job is saved for the next claim() if it names another
        queued job; of metrics, whole numbers in range under the names in COUNTS. A writer that comes between is no harm:
        the change is made again on what that one left."""
        while True:
            version = self.version()
            jobs, choice = self._read(version)
            own = jobs.where((F.col("id") == job) & (F.col("status") == "running")).collect()
            if not own:
                raise ValueError(f"{job} is not running")
            if next_job is not None and next_job != job and jobs.where((F.col("id") == next_job) & (F.col("status") == "queued")).limit(1).count():
                choice = next_job
            kept = {k: v for k, v in (metrics or {}).items() if k in COUNTS and type(v) is int and 0 <= v <= MOST} | ({"error_code": error} if error else {})
            status, reason = ("completed", "") if code == 0 else ("queued", "checkpoint yielded") if code == AGAIN else ("failed", error or f"adapter exit {code}")
            if seconds > settings.budgets[own[0]["kind"]] + GRACE:
                status, reason = "blocked", "adapter exceeded cooperative budget; inspect before retry"
            mine = F.col("id") == job
            put = lambda c, v: F.when(mine, v).otherwise(F.col(c))
            new = jobs.withColumns({"status": put("status", F.lit(status)), "reason": put("reason", F.lit(reason)), "elapsed": put("elapsed", F.col("elapsed") + float(seconds)),
                                    "metrics": put("metrics", F.lit(json.dumps(kept, sort_keys=True)))})
            try:
                self.commit(new, version, choice)
                return status
            except Conflict:
                continue


def offered(jobs: DataFrame, settings: Settings, memory: Memory) -> DataFrame:
    """jobs with fit (null: not waiting; else whether it can run now), its reason, and share, what its kind has used of its
    budget so far. Waiting are queued jobs, and blocked ones whose reason was memory.

    Not fit are jobs whose adapter is missing, of another kind or not ready, proposals where publication is off, and
    those that need memory where the inventory is missing, something unexpected holds some, or too little is free."""
    budget = jobs.sparkSession.createDataFrame(sorted(settings.budgets.items()), "kind string, budget long")
    used = jobs.groupBy("kind").agg(F.sum("elapsed").alias("used"))
    share = used.join(F.broadcast(budget), "kind").select("kind", (F.col("used") / F.col("budget")).alias("share"))
    waits = (F.col("status") == "queued") | ((F.col("status") == "blocked") & F.col("_was").isin(NO_INVENTORY, NO_MEMORY))
    free = 0 if memory.free_mb is None or memory.occupied else memory.free_mb
    asked = runnable(jobs.withColumnRenamed("reason", "_was"), settings.adapters, settings.publish, free, settings.reserve_mb)
    reason = F.when(F.col("reason") == "no memory", NO_INVENTORY if memory.free_mb is None else NO_MEMORY).otherwise(F.col("reason"))
    out = asked.withColumns({"_why": reason, "fit": F.when(waits, reason.isNull())})
    kept = F.when(F.col("fit").isNull(), F.col("_was")).when(F.col("fit"), F.when(F.col("status") == "queued", F.col("_was")).otherwise("")).otherwise(F.col("_why"))
    return out.withColumn("reason", kept).drop("_was", "_why").join(F.broadcast(share), "kind", "left")  # one row for each budget

