"""Ingestion runs: asking for a run that is queued or running gives that run; one that ended may be asked for again."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import store
from . import ingest

QUEUED, RUNNING, SUCCEEDED, FAILED = "queued", "running", "succeeded", "failed"


@dataclass
class Run:
    key: str
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = QUEUED
    result: object = None
    error: str | None = None
    started: float | None = None
    ended: float | None = None


class Runs:
    """Runs of one process."""

    def __init__(self):
        self.by_id: dict[str, Run] = {}

    def enqueue(self, key: str) -> Run:
        for run in self.by_id.values():
            if run.key == key and run.status in (QUEUED, RUNNING):
                return run
        run = Run(key)
        self.by_id[run.job_id] = run
        return run

    def perform(self, run: Run, work: Callable[[], object]) -> Run:
        run.status, run.started = RUNNING, time.time()
        try:
            run.result, run.status = work(), SUCCEEDED
        except Exception as e:  # the run's outcome, not the caller's
            run.error, run.status = f"{type(e).__name__}: {e}", FAILED
        run.ended = time.time()
        return run

    def table(self, spark: SparkSession) -> DataFrame:
        """ingestion_runs"""
        return spark.createDataFrame(
            [(r.job_id, r.key, r.status, r.error, r.started, r.ended) for r in self.by_id.values()],
            "job_id string, idempotency_key string, status string, error string, started double, ended double"
        )


STATE = "job_id string, idempotency_key string, step int, status string, error string, at double"


class SharedRuns:
    """Runs of all processes that share a folder.

    The n-th run for a key belongs to whoever creates the file claims/<hash of key>/<n>, which can be created once. Each state is
    one more file of one line in states/; the last of a run is created once too, so that a run ends once. A reader
    that meets a line half written sees the state before it. A run whose process was killed stays queued or running, and keeps
    its key, until abandon() ends it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _create(self, name: str, content: str = "") -> bool:
        """Whether the file is ours; false where it was there."""
        fs, p = store._path(self.spark, f"{self.folder}/{name}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if not fs.exists(p):
                raise
            return False
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _state(self, run: Run, step: int) -> bool:
        line = {
            "job_id": run.job_id, "idempotency_key": run.key, "step": step, "status": run.status, "error": run.error, "at": time.time()
        }
        return self._create(f"states/{run.job_id}-{step}.json", json.dumps(line) + "\n")

    def ended(self, run: Run) -> bool:
        return store._exists(self.spark, f"{self.folder}/states/{run.job_id}-2.json")

    def enqueue(self, key: str) -> tuple[Run, bool]:
        """The key's run, and whether it is ours to perform: else another call asked for it and it has not ended yet."""
        digest = hashlib.sha256(key.encode()).hexdigest()
        fs, p = store._path(self.spark, f"{self.folder}/claims/{digest}")
        fs.mkdirs(p)
        taken = [f.getPath().getName() for f in fs.listStatus(p)]
        n = max((int(x) for x in taken if x.isdigit()), default=0)
        run = Run(key, f"{digest}-{n}")
        if n and not self.ended(run):
            return run, False
        run = Run(key, f"{digest}-{n + 1}")
        ours = self._create(f"claims/{digest}/{n + 1}")
        if ours:
            self._state(run, 0)
        return run, ours

    def perform(self, run: Run, work: Callable[[], object]) -> Run:
        run.status, run.started = RUNNING, time.time()
        self._state(run, 1)
        try:
            run.result, run.status = work(), SUCCEEDED
        except Exception as e:  # the run's outcome, not the caller's
            run.error, run.status = f"{type(e).__name__}: {e}", FAILED
        run.ended = time.time()
        self._state(run, 2)
        return run

    def abandon(self, run: Run, why: str = "abandoned") -> bool:
        """End a run whose process is gone, so that its key may be asked for again; false if it had ended."""
        run.status, run.error = FAILED, why
        return self._state(run, 2)

    def table(self) -> DataFrame:
        """ingestion_runs of all processes: a row a run, with its last state."""
        fs, p = store._path(self.spark, f"{self.folder}/states")
        fs.mkdirs(p)
        states = self.spark.read.schema(STATE).json(f"{self.folder}/states").filter("job_id IS NOT NULL")
        at = lambda step: F.max(F.when(step, F.col("at")))
        return states.groupBy("job_id", "idempotency_key").agg(
            F.max_by("status", "step").alias("status"), F.max_by("error", "step").alias("error"),
            at(F.col("step") == 1).alias("started"), at(F.col("step") == 2).alias("ended")
        )


def ingest_once(spark: SparkSession, landing: str, tables: str) -> tuple[Run, bool]:
    """Ingest a landing folder unless a process is at it: then its run is given, and false."""
    runs = SharedRuns(spark, f"{tables}/queue")
    run, ours = runs.enqueue(landing)
    return (runs.perform(run, lambda: ingest.run(spark, landing, tables)) if ours else run), ours
