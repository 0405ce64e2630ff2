"""Resource budgets and typed errors. A breach aborts the whole result; nothing partial is returned."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, fields, replace
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_TIMES: ContextVar[list[tuple[str, float]] | None] = ContextVar("times", default=None)


class AnalysisError(Exception):
    """An error with a stable code."""

    code = "analysis_failed"


class InvalidInput(AnalysisError):
    code = "invalid_input"


class DiffInvalid(AnalysisError):
    code = "diff_invalid"


class DiffNotApplied(AnalysisError):
    code = "diff_not_applied"


class ConfigInvalid(AnalysisError):
    code = "config_invalid"


class ProjectInvalid(AnalysisError):
    code = "project_invalid"


class EndpointNotFound(AnalysisError):
    code = "endpoint_not_found"


class OperationNotFound(AnalysisError):
    code = "operation_not_found"


class StageTimeout(AnalysisError):
    code = "stage_timeout"


class Cancelled(AnalysisError):
    code = "cancelled"


class BudgetExceeded(AnalysisError):
    """What was counted, and the limit it passed."""

    code = "budget_exceeded"

    def __init__(self, resource: str, actual: int, limit: int):
        super().__init__(f"{resource}: {actual} is over the limit of {limit}")
        self.resource, self.actual, self.limit = resource, actual, limit


@dataclass(frozen=True)
class Limits:
    """Zero means the default, a negative value is an error."""

    diff_bytes: int = 32 << 20
    line_bytes: int = 4 << 20
    files: int = 5_000
    roots: int = 20_000
    nodes_per_root: int = 200_000
    total_nodes: int = 1_000_000
    depth: int = 256
    load_seconds: int = 120
    walk_seconds: int = 120

    def normalised(self) -> Limits:
        default = Limits()
        for f in fields(self):
            if getattr(self, f.name) < 0:
                raise InvalidInput(f"{f.name} must not be negative")
        return replace(self, **{f.name: getattr(default, f.name) for f in fields(self) if getattr(self, f.name) == 0})


def check(resource: str, actual: int | None, limit: int) -> None:
    if (actual or 0) > limit:
        raise BudgetExceeded(resource, actual, limit)


def check_diff(text: str, limits: Limits) -> None:
    """Whole size and longest line of a diff, in bytes."""
    data = text.encode()
    check("diff bytes", len(data), limits.diff_bytes)
    check("line bytes", max(map(len, data.split(b"\n")), default=0), limits.line_bytes)


def check_walk(visited: DataFrame, limits: Limits, root: str = "root_id") -> None:
    """Nodes of each root, and of all, counted in one aggregate."""
    most, total = visited.groupBy(root).count().agg(F.max("count"), F.sum("count")).first()
    check("nodes per root", most, limits.nodes_per_root)
    check("total nodes", total, limits.total_nodes)


@contextmanager
def stage_times() -> Iterator[list[tuple[str, float]]]:
    """The stages that run inside, in order, and their seconds; those that fail as well."""
    token = _TIMES.set(out := [])
    try:
        yield out
    finally:
        _TIMES.reset(token)


def within(spark: SparkSession, seconds: float, stage: str, work: Callable[[], T]) -> T:
    """work(), its Spark jobs cancelled and StageTimeout raised when it takes longer; Cancelled if others cancel them."""
    late, began = threading.Event(), time.perf_counter()
    spark.addTag(tag := f"stage-{stage}-{id(work)}")

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise StageTimeout(f"{stage} took more than {seconds} s") from e
        if "cancelled" in str(e) and not isinstance(e, AnalysisError):
            raise Cancelled(f"{stage} was cancelled") from e
        raise
    finally:
        timer.cancel()
        if (times := _TIMES.get()) is not None:
            times.append((stage, round(time.perf_counter() - began, 3)))
        spark.removeTag(tag)
