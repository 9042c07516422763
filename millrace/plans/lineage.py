"""What a plan reads and writes: nodes, the edges between their ports, and the outside."""

from __future__ import annotations

import re
from typing import Any

from .compile import Plan

_PLACES = ("path", "url", "table", "topic", "collection", "connection", "brokers", "query")


def public(address: str) -> str:
    """An address without user, password and query; a connection string without its secrets."""
    text = re.sub(r"(?<=://)[^/@\s]*@", "", address)
    text = re.sub(r"(?i)\b(password|passwd|pwd|secret|token|user|username)\s*=\s*('[^']*'|\S+)\s*", "", text)
    return re.sub(r"(://[^?#]*)[?#].*", r"\1", text).strip()


def lineage(plan: Plan) -> dict[str, list[dict[str, Any]]]:
    """{nodes, edges, external}: external holds what sources read from and sinks write to."""
    nodes = [{"id": s.id, "component": s.component.id, "kind": s.component.kind} for s in plan.stages]
    edges = [{"source": source, "output": out, "target": s.id, "input": port} for s in plan.stages for port, source, out in s.inputs]
    external = []
    for s in plan.stages:
        if s.component.kind in ("source", "sink"):
            place = {k: public(str(s.props[k])) for k in _PLACES if isinstance(s.props.get(k), str) and k != "query"}
            external.append({"node": s.id, "direction": "reads" if s.component.kind == "source" else "writes", **place})
    return {"nodes": nodes, "edges": edges, "external": external}
