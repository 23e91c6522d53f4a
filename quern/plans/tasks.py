"""Background jobs (R61-R63): a thread and a Spark job tag for each, and a keyed result cache."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgument, NotFound
from ..functions.text import is_blank
from ..sources.schema import TABLES

RUNNING, SUCCESS, FAILED = "RUNNING", "SUCCESS", "FAILED"


class TaskManager:
    def __init__(self, spark: SparkSession, workers: int = 4, keep: int = 1000, cached: int = 50) -> None:
        self.spark, self.keep, self.cached = spark, keep, cached
        self.pool = ThreadPoolExecutor(workers, thread_name_prefix="quern-task")
        self.tasks: dict[str, dict] = {}
        self.cache: dict[tuple, object] = {}
        self.lock = threading.Lock()

    def submit(self, kind: str, work: Callable[[], object], key: tuple | None = None) -> dict:
        """Accepted at once. key: (dataset version, query, ...); a cached result gives a task that has succeeded already."""
        task_id = uuid.uuid4().hex[:8]
        task = {"task_id": task_id, "type": kind, "status": RUNNING, "timestamp": int(time.time() * 1000)}
        with self.lock:
            ended = [k for k, t in self.tasks.items() if t["status"] != RUNNING]
            for k in ended[: max(0, len(self.tasks) - self.keep + 1)]:  # the oldest that have ended; one that runs can always be polled
                del self.tasks[k]
            self.tasks[task_id] = task
            hit = key is not None and key in self.cache
            if hit:
                task |= {"result": self.cache[key], "message": "Result from cache", "status": SUCCESS}
        if not hit:
            self.pool.submit(inheritable_thread_target(self.spark)(self._run), task, work, key)
        return {"status": "ACCEPTED", "task_id": task_id}

    def _run(self, task: dict, work: Callable[[], object], key: tuple | None) -> None:
        tag = f"quern-{task['task_id']}"
        self.spark.addTag(tag)
        try:
            result = work()
            with self.lock:
                task["result"] = result  # before the status: who sees the status sees the result
                task["status"] = SUCCESS
                if key is not None:
                    if len(self.cache) >= self.cached:
                        self.cache.pop(next(iter(self.cache)))
                    self.cache[key] = result
        except Exception as e:  # the task's outcome, whatever it is
            with self.lock:
                task |= {"error": str(e), "status": FAILED}
        finally:
            self.spark.removeTag(tag)

    def poll(self, task_id: str | None) -> dict:
        """R62."""
        if is_blank(task_id):
            raise InvalidArgument("task_id is missing")
        with self.lock:
            task = self.tasks.get(task_id)
            if task is None:
                raise NotFound(f"no task {task_id}")
            wanted = ["task_id", "type", "status", "timestamp", "message"] + (["result"] if task["status"] == SUCCESS else ["error"] if task["status"] == FAILED else [])
            return {k: task[k] for k in wanted if task.get(k) is not None}

    def wait(self, task_id: str, seconds: float = 60) -> dict:
        end = time.time() + seconds
        while (got := self.poll(task_id))["status"] == RUNNING and time.time() < end:
            time.sleep(0.02)
        return got

    def cancel(self, task_id: str) -> None:
        self.spark.interruptTag(f"quern-{task_id}")

    def forget(self) -> None:
        with self.lock:
            self.cache.clear()

    def table(self) -> DataFrame:
        """The tasks as a relation."""
        with self.lock:
            rows = [(t["task_id"], t["type"], t["status"], None if t.get("result") is None else str(t["result"]), t.get("error"), t["timestamp"]) for t in self.tasks.values()]
        return self.spark.createDataFrame(rows, TABLES["tasks"])

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)
