"""Pipeline documents: nodes that run components, and edges between their ports.

Keys that this version does not know are kept at every level and written back.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

FORMAT_VERSION = 1


class PipelineError(ValueError):
    """Something in a document that is wrong before anything runs."""


@dataclass
class Policy:
    retry_attempts: int = 0
    retry_backoff_ms: int = 250
    continue_on_failure: bool = False
    memory_limit_mb: int | None = None

    @classmethod
    def of(cls, data: dict[str, Any] | None) -> Policy:
        data = data or {}
        return cls(
            int(data.get("retryAttempts") or 0),
            int(data["retryBackoffMs"]) if data.get("retryBackoffMs") is not None else 250,
            bool(data.get("continueOnFailure") or False),
            data.get("memoryLimitMb"),
        )

    @property
    def is_default(self) -> bool:
        return not self.retry_attempts and not self.continue_on_failure


@dataclass
class Node:
    id: str
    component: str | None
    properties: dict[str, Any] = field(default_factory=dict)
    label: str = ""
    alias: str | None = None
    disabled: bool = False
    materialize: str | None = None
    policy: Policy = field(default_factory=Policy)
    incremental: dict[str, Any] | None = None
    raw: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Node:
        if not isinstance(raw.get("id"), str) or not raw["id"]:
            raise PipelineError("every node needs an id")
        data = raw.get("data") or {}
        return cls(
            raw["id"], data.get("componentId"), dict(data.get("properties") or {}), data.get("label") or "", data.get("alias"),
            bool(data.get("disabled") or False), data.get("materialize"), Policy.of(data.get("policy")), data.get("incremental"), raw,
        )

    def to_dict(self) -> dict[str, Any]:
        out = dict(self.raw)
        out["data"] = {**(self.raw.get("data") or {}), "properties": self.properties}
        return out


@dataclass
class Edge:
    id: str
    source: str
    target: str
    source_handle: str | None = None
    target_handle: str | None = None
    raw: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Edge:
        try:
            return cls(raw.get("id", ""), raw["source"], raw["target"], raw.get("sourceHandle"), raw.get("targetHandle"), raw)
        except KeyError as e:
            raise PipelineError(f"an edge has no {e.args[0]}") from None


@dataclass
class Pipeline:
    nodes: list[Node]
    edges: list[Edge]
    name: str | None = None
    format_version: int = FORMAT_VERSION
    parameters: dict[str, dict[str, Any]] = field(default_factory=dict)
    raw: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Pipeline:
        if not isinstance(raw, dict) or not isinstance(raw.get("nodes"), list):
            raise PipelineError("a pipeline is an object with a list of nodes")
        version = int(raw.get("formatVersion") or 0)
        if version > FORMAT_VERSION:
            raise PipelineError(f"format version {version} is newer than {FORMAT_VERSION}")
        return cls([Node.of(x) for x in raw["nodes"]], [Edge.of(x) for x in raw.get("edges") or []], raw.get("name"), version, dict(raw.get("parameters") or {}), raw)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        try:
            return cls.of(json.loads(text))
        except json.JSONDecodeError as e:
            raise PipelineError(f"not JSON: {e}") from e

    @classmethod
    def load(cls, path: str | Path) -> Pipeline:
        return cls.from_json(Path(path).read_text(encoding="utf-8"))

    def to_dict(self) -> dict[str, Any]:
        out = {**self.raw, "nodes": [n.to_dict() for n in self.nodes], "edges": [e.raw for e in self.edges]}
        if self.format_version == 0:  # older documents are not given a version
            out.pop("formatVersion", None)
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)


def pipeline(*steps: tuple[str, str, dict[str, Any]] | tuple[str, str, dict[str, Any], Any], name: str | None = None, **more: Any) -> Pipeline:
    """A document from (id, component, properties[, inputs]) steps.

    inputs is an id, a list of ids, or a dict of input port to id; `id.port` names an output port.
    Without it a step follows the one before. A fifth item holds further node data (alias, policy ...).
    """
    nodes, edges, last = [], [], None
    for step in steps:
        node_id, component, properties = step[:3]
        inputs = step[3] if len(step) > 3 and step[3] is not None else last if not component.startswith("src.") else None
        data = {"label": node_id, "componentId": component, "properties": properties, **(step[4] if len(step) > 4 else {})}
        nodes.append({"id": node_id, "position": {"x": 0.0, "y": 0.0}, "data": data})
        pairs = inputs.items() if isinstance(inputs, dict) else [(None, x) for x in ([inputs] if isinstance(inputs, str) else inputs or [])]
        for port, source in pairs:
            source, _, out = source.partition(".")
            edge = {"id": f"e{len(edges)}", "source": source, "target": node_id}
            edges.append(edge | ({"sourceHandle": out} if out else {}) | ({"targetHandle": port} if port else {}))
        last = node_id
    return Pipeline.of({"formatVersion": FORMAT_VERSION, "name": name, "nodes": nodes, "edges": edges, **more})
