"""What a run needs besides its operators: timing, counters, a deadline, logs, and generated text that is kept."""

from __future__ import annotations

import hashlib
import json
import logging
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_EXCEPTION, CancelledError, ThreadPoolExecutor, wait
from contextlib import contextmanager
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import ask
from gristmill.settings.config import Settings
from gristmill.sinks.files import write_atomic


class Metrics:
    """Counters and duration samples of one driver; tables count through DataFrame.observe (see counted)."""

    def __init__(self):
        self._lock, self.counters, self.durations = threading.Lock(), {}, {}

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self.counters[name] = self.counters.get(name, 0) + n

    def observe(self, name: str, seconds: float) -> None:
        with self._lock:
            self.durations.setdefault(name, []).append(seconds)

    def summary(self) -> dict:
        """Counters, and count, p50, p95 and max of each duration by nearest rank."""
        with self._lock:
            found = {name: sorted(xs) for name, xs in self.durations.items()}
            return {"counters": dict(self.counters), "durations": {n: {"count": len(x), "p50": percentile(x, 0.5), "p95": percentile(x, 0.95), "max": x[-1]} for n, x in found.items()}}

    def write(self, out: TextIO) -> None:
        """Aligned lines, by name."""
        s = self.summary()
        for name, n in sorted(s["counters"].items()):
            print(f"{name:<40} {n}", file=out)
        for name, d in sorted(s["durations"].items()):
            print(f"{name:<40} n={d['count']} p50={d['p50']:.3f}s p95={d['p95']:.3f}s max={d['max']:.3f}s", file=out)


def percentile(ordered: list[float], p: float) -> float:
    """Nearest rank of a sorted list that isn't empty."""
    return ordered[max(0, min(len(ordered) - 1, int(p * len(ordered) + 0.5) - 1))]


def counted(df: DataFrame, metrics: Metrics, name: str) -> DataFrame:
    """df whose rows are added to a counter when it runs, without a job of its own. The counter is read after the action: settle()."""
    from pyspark.sql import Observation

    seen = Observation(name)
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    out.settle = lambda: metrics.add(name, seen.get["n"])
    return out


@contextmanager
def stage(name: str, metrics: Metrics, log: logging.Logger) -> Iterator[None]:
    """Times a stage and logs its end; an error carries the stage's name."""
    begun = time.perf_counter()
    try:
        yield
    except Exception as e:
        took = time.perf_counter() - begun
        metrics.observe(f"stage.{name}", took)
        log.error("stage failed", extra={"stage": name, "duration_ms": int(took * 1000), "error": str(e)[:500]})
        raise RuntimeError(f"{name}: {e}") from e
    took = time.perf_counter() - begun
    metrics.observe(f"stage.{name}", took)
    log.info("stage done", extra={"stage": name, "duration_ms": int(took * 1000)})


class DeadlineExceeded(RuntimeError):
    pass


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels the jobs that run inside once the time is over, and says so."""
    context, group, over = spark.sparkContext, f"run-{time.time_ns()}", threading.Event()

    def stop():
        over.set()
        context.cancelJobsWithTag(group)

    context.addJobTag(group)
    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"run deadline exceeded (RUN_DEADLINE={seconds:g}s)") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(group)


def together(spark: SparkSession, *tasks: Callable[[], object], most: int = 8) -> list:
    """What the tasks return, run side by side, at most so many at a time.

    The first error cancels the jobs of its siblings, tasks that haven't begun don't begin, and the error is raised once all have stopped.
    """
    context, tag = spark.sparkContext, f"together-{uuid.uuid4().hex}"
    inherited, failed = context.getJobTags(), threading.Event()

    def run(task):
        if failed.is_set():
            raise CancelledError("a sibling failed")
        for t in (*inherited, tag):
            context.addJobTag(t)
        try:
            return task()
        except BaseException:
            failed.set()
            raise
        finally:
            context.clearJobTags()

    with ThreadPoolExecutor(max(1, most)) as pool:
        futures = [pool.submit(run, t) for t in tasks]
        done, rest = wait(futures, return_when=FIRST_EXCEPTION)
        first = next((f.exception() for f in futures if f in done and f.exception()), None)
        while first and rest:  # a job that a sibling starts meanwhile is cancelled too
            context.cancelJobsWithTag(tag)
            _, rest = wait(rest, timeout=0.2)
    if first:
        raise first
    return [f.result() for f in futures]


class _Json(logging.Formatter):
    _OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, r: logging.LogRecord) -> str:
        extra = {k: v for k, v in vars(r).items() if k not in self._OWN}
        return json.dumps({"time": self.formatTime(r), "level": r.levelname, "msg": r.getMessage(), **extra}, ensure_ascii=False, default=str)


def logger(settings: Settings, out: TextIO | None = None) -> logging.Logger:
    """JSON lines at the level of the settings."""
    log = logging.getLogger("gristmill")
    handler = logging.StreamHandler(out or sys.stderr)
    handler.setFormatter(_Json())
    log.handlers, log.propagate = [handler], False
    log.setLevel(settings.log_level.upper())
    return log


class TextCache:
    """Generated texts by a hash of system text and prompt; errors and blank texts aren't kept, and equal prompts wait for one another."""

    def __init__(self, folder: str, generate: Callable[[str, str], str], metrics: Metrics):
        self.folder, self.generate, self.metrics = Path(folder), generate, metrics
        self._locks: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()

    def __call__(self, system: str, prompt: str) -> str:
        name = hashlib.sha256(f"{system}\x00{prompt}".encode()).hexdigest()[:16]
        path = self.folder / f"{name}.txt"
        with self._lock:
            mine = self._locks.setdefault(name, threading.Lock())
        with mine:
            if path.exists():
                self.metrics.add("cache.hits")
                return path.read_text()
            self.metrics.add("cache.misses")
            text = self.generate(system, prompt)
            if text:
                write_atomic(path, text.encode())
            return text


class Limiter:
    """At most n at a time; inside Spark the same comes from repartition(n) before the provider."""

    def __init__(self, n: int):
        self._slots = threading.BoundedSemaphore(max(1, n))

    @contextmanager
    def slot(self, timeout: float | None = None) -> Iterator[None]:
        if not self._slots.acquire(timeout=timeout):
            raise TimeoutError("no free slot")
        try:
            yield
        finally:
            self._slots.release()


def cached_table(spark: SparkSession, wanted: DataFrame, path: str, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows by key: those at path, and what build makes of the wanted ones that aren't there, which are added to it first."""
    from pyspark.errors import AnalysisException

    try:
        known = spark.read.parquet(path)
    except AnalysisException:
        known = None
    missing = wanted if known is None else wanted.join(known.select(key), key, "left_anti")
    if known is None or not missing.isEmpty():
        build(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def complete(url: str, key: str, model: str, timeout: float) -> Callable[[str, str], dict]:
    """A chat completion: {text, input_tokens, output_tokens, cost, seconds, error}."""

    def ask_one(system: str, prompt: str) -> dict:
        begun = time.perf_counter()
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        reply, wrong = ask.post(f"{url.rstrip('/')}/chat/completions", {"Authorization": f"Bearer {key}"}, json.dumps({"model": model, "messages": messages}).encode(), timeout)
        out = {"text": "", "input_tokens": 0, "output_tokens": 0, "cost": None, "seconds": time.perf_counter() - begun, "error": wrong}
        if reply is not None:
            choices, usage = reply.get("choices") or [], reply.get("usage") or {}
            out |= {"text": (choices[0].get("message", {}).get("content") or "") if choices else "", "input_tokens": usage.get("prompt_tokens", 0), "output_tokens": usage.get("completion_tokens", 0), "cost": usage.get("cost")}
            out["error"] = None if choices else "no choices in the reply"
        return out

    return ask_one


def generated(rows: DataFrame, key: str, system: str, prompt: str, settings: Settings, runs: int = 1) -> DataFrame:
    """(key, run, said, input_tokens, output_tokens, cost, seconds, error): completions for every row's prompt, `generator_concurrency` at a time.

    Failures stay in the row. Equal prompts are asked once a run; runs count from 0.
    """
    send = complete(settings.generator_url, settings.generator_key, settings.generator_model, settings.generator_timeout)

    def batches(frames):
        for frame in frames:
            out = [send(system, p) for p in frame["prompt"]]
            yield frame[["prompt", "run"]].assign(said=[o["text"] or None for o in out], **{k: [o[k] for o in out] for k in ("input_tokens", "output_tokens", "cost", "seconds", "error")})

    asked = rows.select(key, F.col(prompt).alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    once = asked.select("prompt", "run").distinct().repartition(settings.generator_concurrency)
    said = once.mapInPandas(batches, "prompt string, run int, said string, input_tokens long, output_tokens long, cost double, seconds double, error string")
    return asked.join(said, ["prompt", "run"], "left").drop("prompt")
