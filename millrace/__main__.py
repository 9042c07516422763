"""The command line: run, validate, plan, preview, components, schema, lineage, runs, state.

Exit codes: 0 all well, 1 wrong use or a file that cannot be read, 2 an invalid pipeline, 3 a run that failed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .model import Pipeline, PipelineError
from .params import Resolver, load_contexts, resolve
from .plans.compile import compile_pipeline
from .plans.lineage import lineage
from .registry import json_schema, manifest
from .state import StateError, Store


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _resolver(a: argparse.Namespace) -> Resolver:
    contexts, active = load_contexts(a.workspace)
    given = dict(x.split("=", 1) for x in a.param)
    return Resolver(explicit=given, contexts=contexts, active=a.context or active, workspace=os.path.abspath(a.workspace), secrets=lambda n: os.environ.get(f"MILLRACE_SECRET_{n}"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "validate", "plan", "preview", "lineage", "runs", "state"):
        s = sub.add_parser(name)
        s.add_argument("pipeline")
        s.add_argument("--workspace", default=".")
        s.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
        s.add_argument("--context")
        if name == "run":
            s.add_argument("--counts", choices=("sinks", "all", "none"), default="sinks")
        if name == "preview":
            s.add_argument("node")
            s.add_argument("--limit", type=int, default=20)
        if name == "state":
            s.add_argument("--reset", action="store_true")
    sub.add_parser("components")
    sub.add_parser("schema")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    show = lambda x: print(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    if a.command in ("components", "schema"):
        show(manifest() if a.command == "components" else json_schema())
        return 0
    try:
        doc = Pipeline.load(a.pipeline)
        store = Store(a.workspace)
        if a.command in ("runs", "state"):
            name = doc.name or "pipeline"
            if a.command == "state" and a.reset:
                store.reset(name)
            show(store.runs(name) if a.command == "runs" else store.load(name))
            return 0
        resolved = resolve(doc, _resolver(a))
        plan = compile_pipeline(resolved.pipeline)
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    except (PipelineError, StateError) as e:
        print(e, file=sys.stderr)
        return 2
    for w in [*resolved.warnings, *plan.warnings]:
        print(f"warning: {w}", file=sys.stderr)
    if a.command == "validate":
        print(f"{len(plan.stages)} stages")
    elif a.command == "plan":
        show([{"id": s.id, "component": s.component.id, "inputs": s.inputs, "materialize": s.materialize} for s in plan.stages])
    elif a.command == "lineage":
        show(lineage(plan))
    elif a.command == "preview":
        from .plans.run import preview

        rows, columns, more = preview(_session(), doc, a.node, a.limit, resolver=_resolver(a))
        show({"columns": columns, "rows": rows, "more": more})
    else:
        from .plans.run import RunFailed, report_json, run

        try:
            report = run(_session(), doc, resolver=_resolver(a), store=store, counts=a.counts)
        except RunFailed as e:
            print(report_json(e.report))
            print(e, file=sys.stderr)
            return 3
        print(report_json(report))
        return 0 if report.ok else 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
