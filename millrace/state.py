"""What is remembered between runs: positions, by pipeline, and the history of runs."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

VERSION = 1


class StateError(RuntimeError):
    pass


class Store:
    """Files in <workspace>/.etl; each is replaced as a whole, so a reader sees the old or the new one."""

    def __init__(self, workspace: str | Path):
        self.root = Path(workspace, ".etl")

    def _file(self, kind: str, pipeline: str, end: str) -> Path:
        safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in pipeline)
        return self.root / kind / f"{safe}.{end}"

    def load(self, pipeline: str) -> dict[str, Any]:
        path = self._file("state", pipeline, "json")
        if not path.exists():
            return {}
        try:
            data = json.loads(path.read_text(encoding="utf-8"))
            version, nodes = data["version"], data["nodes"]
        except (ValueError, KeyError, TypeError) as e:
            raise StateError(f"{path} is damaged: {e}") from None
        if version > VERSION:
            raise StateError(f"{path} has version {version}, newer than {VERSION}")
        return nodes

    def save(self, pipeline: str, nodes: dict[str, Any]) -> None:
        path = self._file("state", pipeline, "json")
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, made = tempfile.mkstemp(dir=path.parent)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "nodes": nodes}, f, indent=2)
        os.replace(made, path)

    def reset(self, pipeline: str, node: str | None = None) -> None:
        nodes = self.load(pipeline)
        self.save(pipeline, {k: v for k, v in nodes.items() if node is not None and k != node})

    def record(self, pipeline: str, report: Any, ok: bool) -> None:
        path = self._file("runs", pipeline, "jsonl")
        path.parent.mkdir(parents=True, exist_ok=True)
        entry = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "ok": ok, "seconds": round(report.seconds, 3), "stages": [asdict(s) for s in report.stages], "marks": report.marks}
        with path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")

    def runs(self, pipeline: str, last: int | None = None) -> list[dict[str, Any]]:
        path = self._file("runs", pipeline, "jsonl")
        lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
        return [json.loads(x) for x in (lines[-last:] if last else lines)]

    def prune(self, pipeline: str, keep: int) -> None:
        """Leaves the last `keep` runs in the history."""
        path = self._file("runs", pipeline, "jsonl")
        lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
        if len(lines) > keep:
            made = path.with_suffix(".new")
            made.write_text("".join(x + "\n" for x in lines[len(lines) - keep :]), encoding="utf-8")
            os.replace(made, path)
