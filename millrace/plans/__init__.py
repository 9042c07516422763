"""From a document to DataFrames: the order of its nodes, and a run with its report."""

from .compile import Plan, compile_pipeline, preview_plan
from .run import RunFailed, RunReport, preview, run

__all__ = ["Plan", "RunFailed", "RunReport", "compile_pipeline", "preview", "preview_plan", "run"]
