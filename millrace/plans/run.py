"""Runs a plan: DataFrames are built lazily, and each sink is one action.

A stage that fails stops the run unless its policy says otherwise; what depends on it is skipped.
Sinks that deliver to other systems run last and only if nothing failed; then positions are saved.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import Pipeline
from ..operators.control import NotTaken
from ..params import Resolver, resolve
from ..registry import REJECTED, Step
from ..state import Store
from ..storage import delete, new_path
from ..streaming.incremental import Marks, keep_after
from .compile import Plan, Stage, compile_pipeline, preview_plan


@dataclass
class StageReport:
    id: str
    component: str
    status: str = "ok"  # ok, failed, skipped, not_taken, withheld
    attempts: int = 1
    seconds: float = 0.0
    rows: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    notes: list[str] = field(default_factory=list)


@dataclass
class RunReport:
    name: str | None
    stages: list[StageReport] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    marks: dict[str, str] = field(default_factory=dict)
    seconds: float = 0.0

    @property
    def ok(self) -> bool:
        return not any(s.status == "failed" for s in self.stages)

    def stage(self, node: str) -> StageReport:
        return next(s for s in self.stages if s.id == node)


class RunFailed(RuntimeError):
    """A stage failed and its policy does not let the run go on; `report` tells how far it came."""

    def __init__(self, report: RunReport, stage: StageReport):
        super().__init__(f"stage '{stage.id}' ({stage.component}) failed: {stage.error}")
        self.report, self.stage = report, stage


class _Runner:
    def __init__(self, spark: SparkSession, plan: Plan, *, counts: str, state: Mapping[str, Any], mask: Callable[[str], str], context: dict[str, Any], saves: bool = False):
        self.saves = saves
        self.spark, self.plan, self.counts, self.mask, self.given = spark, plan, counts, mask, context
        self.report = RunReport(plan.name, warnings=list(plan.warnings))
        self.frames: dict[tuple[str, str], DataFrame] = {}
        self.relations: dict[str, DataFrame] = {}
        self.marks = Marks(state)
        self.persisted: list[DataFrame] = []
        self.written: dict[int, DataFrame] = {}
        self.scratch: list[str] = []
        self.observed: list[tuple[StageReport, str, Observation]] = []
        self.settled: list[Callable[[bool], None]] = []
        self.deferred: list[tuple[Stage, StageReport, Any, DataFrame]] = []

    # --- one stage ---------------------------------------------------------------------------------

    def _step(self, stage: Stage, report: StageReport) -> Step:
        by_port = {port: self.frames[source, out] for port, source, out in stage.inputs}
        by_id = {s.id: s for s in self.plan.stages}
        names = {port: [source, *([by_id[source].node.alias] if by_id[source].node.alias else [])] for port, source, _ in stage.inputs}
        context = {
            **self.given, "names": names, "note": report.notes.append, "held": self._held,
            "position": self.marks.position(stage.id), "track": lambda df, c: self._tracked(stage.id, df, c),
            "set_position": lambda value: self.marks.set(stage.id, value), "settle": self.settled.append,
        }
        return Step(stage.id, stage.component.id, dict(stage.props), self.spark, list(by_port.values()), by_port, context, dict(self.relations))

    def _held(self, df: DataFrame) -> DataFrame:
        """A relation that is read more than once here: written to the shared folder until the run ends,
        so that its rows are the same for all that read them whatever executors are lost."""
        if df.storageLevel != StorageLevel.NONE or id(df) in self.written:
            return df
        path = new_path(self.spark, "stage")
        self.scratch.append(path)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.written[id(back)] = back
        return back

    def _tracked(self, node: str, df: DataFrame, column: str) -> DataFrame:
        """An increment whose mark is saved after the run. The source is read once, into the shared folder:
        the sinks and the mark see the same rows, whatever arrives meanwhile comes after the mark."""
        if self.saves:
            df = self._held(df)
        self.marks.track(node, df, column)
        return df

    def _materialized(self, stage: Stage, df: DataFrame) -> DataFrame:
        how = stage.materialize
        # Rows drawn at random, in no order or by a model must be the same for all that read them.
        loose = stage.component.id.startswith("xf.ai.") or stage.component.id == "xf.sample" or (stage.component.id == "xf.dedup" and not stage.props["order_by"]) or (stage.component.id == "xf.limit")
        if how == "auto" and loose and self.plan.uses(stage.id, "main") > 1:
            how = "disk"
        if how == "memory":
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.persisted.append(df)
            df.count()
        elif how == "disk":
            df = self._held(df)
        return df

    def _once(self, stage: Stage, report: StageReport) -> None:
        step = self._step(stage, report)
        made = stage.component.build(step)
        if stage.component.kind == "sink":
            df = step.df
            if stage.component.deferred:
                self.deferred.append((stage, report, made, df))
                return
            self._deliver(stage, report, made, df)
            return
        outputs = made if isinstance(made, dict) else {stage.component.outputs[0]: made}
        if stage.component.kind == "source" and stage.node.incremental:
            column = stage.node.incremental["column"]
            after = keep_after(outputs["main"], column, self.marks.position(stage.id) or stage.node.incremental.get("start"))
            outputs["main"] = self._tracked(stage.id, after, column)
        outputs["main"] = self._materialized(stage, outputs["main"])
        if not stage.node.policy.is_default and stage.materialize in ("auto", "view"):
            outputs["main"] = self._held(outputs["main"])  # a policy needs to know now whether the stage works
        for port, df in outputs.items():
            if self.counts == "all":
                n = Observation()
                df = df.observe(n, F.count(F.lit(1)).alias("n"))
                self.observed.append((report, port, n))
            self.frames[stage.id, port] = df
        self.relations[stage.id] = self.frames[stage.id, "main"]
        if stage.node.alias:
            self.relations[stage.node.alias] = self.relations[stage.id]
        if (stage.id, REJECTED) in self.frames:
            self.relations[f"{stage.id}__{REJECTED}"] = self.frames[stage.id, REJECTED]

    def _deliver(self, stage: Stage, report: StageReport, write: Callable[[DataFrame], Any], df: DataFrame) -> None:
        n = Observation()
        sent = write(df.observe(n, F.count(F.lit(1)).alias("n")) if self.counts != "none" else df)
        if isinstance(sent, int):
            report.rows["in"] = sent
        elif self.counts != "none":
            self.observed.append((report, "in", n))

    def _attempts(self, stage: Stage, report: StageReport, act: Callable[[], None]) -> None:
        policy = stage.node.policy
        for attempt in range(1, policy.retry_attempts + 2):
            report.attempts = attempt
            try:
                act()
                return
            except NotTaken:
                raise
            except Exception:
                if attempt > policy.retry_attempts:
                    raise
                time.sleep(policy.retry_backoff_ms / 1000 * 2 ** (attempt - 1))

    # --- the run -----------------------------------------------------------------------------------

    def run(self) -> RunReport:
        began = time.monotonic()
        lost: dict[str, str] = {}
        try:
            for stage in self.plan.stages:
                report = StageReport(stage.id, stage.component.id)
                self.report.stages.append(report)
                before = {lost[source] for _, source, _ in stage.inputs if source in lost}
                if before:
                    lost[stage.id] = report.status = "skipped" if "skipped" in before or "failed" in before else "not_taken"
                    continue
                at = time.monotonic()
                try:
                    self._attempts(stage, report, lambda s=stage, r=report: self._once(s, r))
                except NotTaken:
                    lost[stage.id] = "not_taken"
                    report.notes.append("the predicate holds for no row")
                except Exception as e:
                    lost[stage.id] = report.status = "failed"
                    report.error = self.mask(_message(e))
                    if not stage.node.policy.continue_on_failure:
                        raise RunFailed(self.report, report) from e
                finally:
                    report.seconds = time.monotonic() - at
            self._finish()
        finally:
            self._settle(False)
            self.report.seconds = time.monotonic() - began
            for df in self.persisted:
                df.unpersist()
            for path in self.scratch:
                delete(self.spark, path)
        return self.report

    def _settle(self, ok: bool) -> None:
        """Messages on loan from queues: acknowledged after all deliveries, or given back."""
        while self.settled:
            settle = self.settled.pop()
            try:
                settle(ok)
            except Exception as e:  # they come again; what was delivered stays delivered
                self.report.warnings.append(self.mask(f"messages could not be {'acknowledged' if ok else 'given back'}: {_message(e)}"))

    def _finish(self) -> None:
        """Deliveries to other systems, then counts and positions, if nothing failed."""
        if not self.report.ok:
            for _, report, _, _ in self.deferred:
                report.status = "withheld"
        else:
            for stage, report, write, df in self.deferred:
                try:
                    self._attempts(stage, report, lambda s=stage, r=report, w=write, d=df: self._deliver(s, r, w, d))
                except Exception as e:
                    report.status, report.error = "failed", self.mask(_message(e))
                    raise RunFailed(self.report, report) from e
            self._settle(True)
            self.report.marks = self.marks.new()
        patience = time.monotonic() + 3  # counts arrive a moment after their action; those of unread outputs never do
        for report, port, n in self.observed:
            found = _observed(n, patience)
            if found is not None:
                report.rows[port] = found


def _observed(n: Observation, until: float) -> int | None:
    """An observation's count, if an action has read what it watches; waits for it until a time."""
    try:
        while n._jo is not None and not n._jo.future().isCompleted():
            if time.monotonic() > until:
                return None
            time.sleep(0.02)
        return n.get["n"] if n._jo is not None else None
    except Exception:  # the action ended without its metrics
        return None


def _message(e: Exception) -> str:
    text = str(e).strip()
    return text.split("\nJVM stacktrace")[0][:2000] or type(e).__name__


def run(spark: SparkSession, pipeline: Pipeline | Plan, *, resolver: Resolver | None = None, store: Store | None = None, counts: str = "sinks", context: dict[str, Any] | None = None) -> RunReport:
    """Runs a pipeline and reports on each of its stages.

    counts: rows of `sinks` (as they are written, at no cost), of `all` stages' outputs (which keeps
    filters from being pushed through them), or `none`. With a store, saved positions are read
    first, and new ones saved once everything has been delivered; every run is added to its history.
    """
    mask, warnings = (lambda x: x), []
    if isinstance(pipeline, Pipeline):
        resolved = resolve(pipeline, resolver)
        mask, warnings = resolved.mask, resolved.warnings
        pipeline = compile_pipeline(resolved.pipeline)
    state = store.load(pipeline.name or "pipeline") if store else {}
    runner = _Runner(spark, pipeline, counts=counts, state=state, mask=mask, context=context or {}, saves=store is not None)
    runner.report.warnings += warnings
    try:
        report = runner.run()
    except RunFailed as e:
        if store:
            store.record(pipeline.name or "pipeline", e.report, ok=False)
        raise
    if store:
        if report.ok:
            store.save(pipeline.name or "pipeline", {**state, **{k: {"position": v} for k, v in report.marks.items()}})
        store.record(pipeline.name or "pipeline", report, ok=report.ok)
    return report


def preview(spark: SparkSession, pipeline: Pipeline, node: str, limit: int = 100, *, port: str = "main", resolver: Resolver | None = None) -> tuple[list[dict[str, Any]], list[str], bool]:
    """(rows, columns, whether there are more) of a node's output; no sink runs and nothing is saved."""
    limit = min(limit, 500)
    plan = preview_plan(compile_pipeline(resolve(pipeline, resolver).pipeline), node)
    runner = _Runner(spark, plan, counts="none", state={}, mask=lambda x: x, context={})
    try:
        for stage in plan.stages:
            runner._once(stage, StageReport(stage.id, stage.component.id))
        df = runner.frames[node, port]
        rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        return rows[:limit], df.columns, len(rows) > limit
    finally:
        runner._settle(False)
        for df in runner.persisted:
            df.unpersist()
        for path in runner.scratch:
            delete(spark, path)


def frames(spark: SparkSession, pipeline: Pipeline, *, resolver: Resolver | None = None, context: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """The lazy DataFrame of every node without sinks, by id (and `id.port` for further outputs).

    For use from code: what a stage keeps in memory stays until it is unpersisted, and nothing is
    delivered or saved.
    """
    plan = compile_pipeline(resolve(pipeline, resolver).pipeline)
    plan = Plan([s for s in plan.stages if s.component.kind != "sink"], plan.warnings, plan.name)
    runner = _Runner(spark, plan, counts="none", state={}, mask=lambda x: x, context=context or {})
    lost: set[str] = set()
    for stage in plan.stages:
        if any(source in lost for _, source, _ in stage.inputs):
            lost.add(stage.id)
            continue
        try:
            runner._once(stage, StageReport(stage.id, stage.component.id))
        except NotTaken:
            lost.add(stage.id)
    runner._settle(False)  # what came from queues has been read, and goes back to them
    return {n if p == "main" else f"{n}.{p}": df for (n, p), df in runner.frames.items()}


def report_json(report: RunReport) -> str:
    return json.dumps({"name": report.name, "ok": report.ok, "seconds": round(report.seconds, 3), "warnings": report.warnings, "marks": report.marks, "stages": [s.__dict__ for s in report.stages]})
